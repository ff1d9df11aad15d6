"""Batched tokenisation with a per-worker cache of space-delimited chunks.

Both public vocabularies split text before merging, and a cut in front of a single space that is
followed by a non-space character always coincides with such a split.  Encoding each distinct chunk
once and gathering ids by table lookup therefore gives exactly the ids of the whole text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept per worker process; beyond, those met only once or twice go (a memory bound, not a result bound).
CACHE_CHUNKS = 500_000
#: Chunks given to the library at once.
ENCODE_CHUNKS = 20_000

_WEIRD = re.compile(r" (?:\s|$)")
_WEIRD_RE2 = r" \z|[ \n][\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]"
_loaded: dict[tuple[str, bool], ChunkTokenizer] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkCache:
    """Ids of chunks, kept in flat arrays; subclasses encode chunks that are met for the first time.

    leading_space: chunks keep the space in front of them; bare_first: a text's first one has none.
    odd: texts that are cut by chunks() one by one, as spaces meet other white space in them.

    Known chunks are an Arrow array of keys without the space, which Arrow looks up in bulk; a key
    with one space in front stands for a first chunk, with two for a chunk of an odd text.
    """

    odd = _WEIRD_RE2
    bare_first = True

    def __init__(self, leading_space: bool) -> None:
        self.leading_space = leading_space
        self.bare_first = self.bare_first and leading_space
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.starts = self.lengths = self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the chunks met at least three times, if those are few enough."""
        often = self.uses >= 3
        if often.sum() > CACHE_CHUNKS // 2:
            often[:] = False
        lengths, starts = self.lengths[often], self.starts[often]
        ends = np.cumsum(lengths)
        self.flat = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.known = self.known.filter(pa.array(often))
        self.lengths, self.starts, self.uses = lengths, ends - lengths, np.zeros(len(lengths), np.int64)

    def _chunk(self, key: str) -> str:
        if key[:1] == " ":
            return key[2:] if key[1:2] == " " else key[1:]
        return " " + key if self.leading_space and key and key[0] != "\n" else key

    def _learn(self, keys: pa.Array) -> None:
        chunks = [self._chunk(k) for k in keys.to_pylist()]
        starts, sizes, flats, at = [self.starts], [self.lengths], [self.flat], len(self.flat)
        for i in range(0, len(chunks), ENCODE_CHUNKS):
            lengths, flat = self._encode_chunks(chunks[i : i + ENCODE_CHUNKS])
            starts.append(at + np.cumsum(lengths) - lengths)
            sizes.append(lengths)
            flats.append(flat)
            at += len(flat)
        self.starts, self.lengths, self.flat = map(np.concatenate, (starts, sizes, flats))
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])
        self.known = pa.concat_arrays([self.known, keys])

    def _numbers(self, keys: pa.Array) -> np.ndarray:
        """Where each key's ids are kept; new ones are encoded first."""
        found = pc.index_in(keys, value_set=self.known)
        if not found.null_count:
            return found.to_numpy(zero_copy_only=False).astype(np.int64)
        missing = pc.is_null(found)
        out = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lost = keys.filter(missing)
        fresh, before = pc.unique(lost), len(self.known)
        self._learn(fresh)
        out[missing.to_numpy(zero_copy_only=False)] = before + pc.index_in(lost, value_set=fresh).to_numpy(zero_copy_only=False)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (strings, no nulls) in a row, and how many belong to each text."""
        if len(self.known) > CACHE_CHUNKS:
            self._forget()
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.leading_space else np.zeros(len(texts), bool)
        # a line feed between other characters is a split too; without leading spaces it is only white space
        lines = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n" if self.leading_space else " ")
        pieces = pc.split_pattern(lines, " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py() if len(pieces) else np.zeros(1, np.int64)
        keys = pieces.flatten()
        if self.bare_first and len(keys):
            first = np.zeros(len(keys), bool)
            first[bounds[:-1]] = True
            even = np.empty(len(keys), np.int64)
            heads = pc.binary_join_element_wise(pa.scalar(" "), keys.filter(pa.array(first)), "")
            even[first] = self._numbers(heads)
            even[~first] = self._numbers(keys.filter(pa.array(~first)))
        else:
            even = self._numbers(keys)
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = np.diff(bounds)
        if odd.any():
            cut = [self.chunks(texts[int(i)].as_py()) for i in np.flatnonzero(odd)]
            counts[odd] = [len(c) for c in cut]
            at = np.empty(int(counts.sum()), np.int64)
            is_odd = np.repeat(odd, counts)
            at[is_odd] = self._numbers(pa.array(["  " + c for chunks in cut for c in chunks], pa.string()))
            at[~is_odd] = even
        else:
            at = even
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(total)


class ChunkTokenizer(ChunkCache):
    """ids of whole texts.  leading_space: chunks keep their space (byte-level), else spaces are dropped.

    The vocabulary's added tokens are looked for in the text as it is, before anything else, as the
    library does; what lies between them is cut into chunks.
    """

    def __init__(self, path: str, leading_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # chunks are cached here
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"added tokens that take in white space or are normalised: {path}")
        self.added = {t.content: i for i, t in added.items()}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self._added = re.compile(f"({'|'.join(longest_first)})") if added else None
        super().__init__(leading_space)
        # a line feed is a token of its own between chunks without white space; so is a digit between spaces
        self.mark = "\n" if leading_space else " 1 "
        self._plain = re.compile(r" ?\S+" if leading_space else r"[^\s1]*").fullmatch
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = np.zeros(len(texts), bool)
        for content in self.added:
            marked |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not marked.any():
            return super().encode(texts)
        parts = [self._added.split(x.as_py()) if m else [x.as_py()] for x, m in zip(texts, marked.tolist())]
        between, counts = super().encode(pa.array([x for p in parts for x in p[::2]], pa.string()))
        marks = np.array([self.added[x] for p in parts for x in p[1::2]], np.uint32)
        sizes = np.array([len(p) // 2 + 1 for p in parts])
        last = np.zeros(len(counts), bool)
        last[np.cumsum(sizes) - 1] = True
        ids = np.insert(between, np.cumsum(counts)[~last], marks)
        total = np.concatenate([[0], np.cumsum(counts + ~last)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(total)

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain chunks go to the library joined by a mark whose one id no plain chunk contains."""
        fed = np.fromiter((c[:1] == "\n" and len(c) > 1 and not c[1].isspace() for c in chunks), bool, len(chunks))
        chunks = [c[1:] if f else c for c, f in zip(chunks, fed.tolist())]
        plain = np.fromiter((self._plain(c) is not None for c in chunks), bool, len(chunks))
        single = [e.ids for e in self.tokenizer.encode_batch_fast([c for c, p in zip(chunks, plain) if not p], add_special_tokens=False)]
        joined = [c for c, p in zip(chunks, plain) if p]
        groups = [self.mark.join(joined[i : i + 500]) for i in range(0, len(joined), 500)]
        ids = [np.array([*e.ids, self.mark_id], np.uint32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate([*ids, np.zeros(0, np.uint32)])
        is_mark = ids == self.mark_id
        ends = np.flatnonzero(is_mark)
        if len(ends) != len(joined):
            raise ValueError("the mark's id occurs within a chunk")
        lengths = np.empty(len(chunks), np.int64)
        lengths[plain] = np.diff(ends, prepend=-1) - 1
        lengths[~plain] = [len(x) for x in single]
        flat = np.empty(int(lengths.sum()), np.uint32)
        of_plain = np.repeat(plain, lengths)
        flat[of_plain] = ids[~is_mark]
        flat[~of_plain] = list(chain.from_iterable(single))
        if fed.any():  # a line feed in front is a token of its own
            flat = np.insert(flat, (np.cumsum(lengths) - lengths)[fed], np.uint32(self.mark_id))
            lengths += fed
        return lengths, flat

    def chunks(self, text: str) -> list[str]:
        parts = text.split(" ")
        if not self.leading_space:
            return parts
        if _WEIRD.search(text) is None:
            # no space is followed by white space: every space starts a chunk
            return [parts[0], *[" " + p for p in parts[1:]]]
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out


def tokenizer(path: str, leading_space: bool) -> ChunkTokenizer:
    """One per worker process and vocabulary."""
    if (path, leading_space) not in _loaded:
        _loaded[path, leading_space] = ChunkTokenizer(path, leading_space)
    return _loaded[path, leading_space]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to each text's ids."""
    after = np.cumsum(counts)
    return np.insert(ids, after, np.uint32(end_id)), counts + 1

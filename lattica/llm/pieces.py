"""SentencePiece encoding and decoding by suffix-array matching.

New chunks of a batch are concatenated and their suffixes sorted; a binary search finds the range of
suffixes that begin with each piece, which gives every occurrence of every piece.  These edges are
sorted by where they end and relaxed from left to right.

For a unigram-like model relaxing would keep the best score.  The public vocabulary is a merge
(BPE) model, whose result is not the best-scored path; here an edge is kept if its piece and the
last piece of the prefix before it are what merging makes of the two together.  Exactly one edge
into each place passes, and the path is the merge result.

Text is escaped as the model does (a space in front, spaces as U+2581); characters without a piece
become byte pieces.  Null text is empty and has no pieces.  Repeated rows are encoded alike; extra
columns are ignored; whole texts are encoded; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, read_table, text_rows, tune
from .tokenize import ChunkCache, vocabulary_path

_SPACE = "▁"
_START, _BYTES = -1, -2
_loaded: dict[str, PieceCodec] = {}


class PieceModel:
    """Pieces, their ranks (lower merges first) and how each is merged."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {i: int(model.id_to_piece(i)[3:5], 16) for i in ids if model.is_byte(i)}
        self.byte_ids = np.array([i for i, _ in sorted(self.bytes.items(), key=lambda x: x[1])], np.int64)
        self.text = {i: model.id_to_piece(i) for i in ids if i not in special and i not in self.bytes}
        self.id = {t: i for i, t in self.text.items()}
        self.rank = {i: -model.get_score(i) if len(t) > 1 else -1.0 for i, t in self.text.items()}
        self.split: dict[int, tuple[int, int]] = {}
        #: Pieces that merging their own text gives; others never occur.
        self.usable = [i for i, t in self.text.items() if self._merges_to_itself(i, t)]
        self._valid: dict[tuple[int, int], bool] = {}

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Pieces of a text whose characters all are pieces, and the last merge made."""
        parts, last = [self.id[c] for c in text], None
        while True:
            best = None
            for k in range(len(parts) - 1):
                m = self.id.get(self.text[parts[k]] + self.text[parts[k + 1]])
                if m is not None and (best is None or self.rank[m] < best[0]):
                    best = self.rank[m], k, m
            if best is None:
                return parts, last
            _, k, m = best
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [m]

    def _merges_to_itself(self, i: int, text: str) -> bool:
        if len(text) == 1:
            return True
        if any(c not in self.id for c in text):
            return False
        parts, last = self.merge(text)
        if parts == [i]:
            self.split[i] = last
            return True
        return False

    def valid(self, a: int, b: int) -> bool:
        """Whether merging a's and b's texts together leaves exactly a and b.

        Undo the later of the two sides' last merges again and again; if a merge over the seam
        would have come before the undone one (the left one first if equal), the seam is lost.
        """
        if a < 0 or b < 0:
            return True
        key = a, b
        if key not in self._valid:
            bound = float("inf")
            while True:
                m = self.id.get(self.text[a] + self.text[b])
                if m is not None and self.rank[m] < bound:
                    ok = False
                    break
                if a not in self.split and b not in self.split:
                    ok = True
                    break
                if self.rank[a] > self.rank[b]:
                    bound, a = self.rank[a], self.split[a][1]
                else:
                    bound, b = np.nextafter(self.rank[b], np.inf), self.split[b][0]
            if len(self._valid) > 2_000_000:
                self._valid.clear()
            self._valid[key] = ok
        return self._valid[key]


def _big_endian(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = out << np.uint64(8) | data[at + j]
    return out


class PieceCodec(ChunkCache):
    #: A space in front would join the one that the model adds, a mark the spaces around it.
    odd = r"\A[ \n]|▁|" + ChunkCache.odd
    bare_first = False

    def __init__(self, path: str) -> None:
        super().__init__(True)
        self.model = m = PieceModel(path)
        raw = {i: m.text[i].encode() for i in m.usable}
        self.short = sorted((b, i) for i, b in raw.items() if len(b) <= 8)
        self.long = sorted((b, i) for i, b in raw.items() if len(b) > 8)
        n = max(m.text) + 1
        self.size = np.zeros(n, np.int64)
        for i, b in raw.items():
            self.size[i] = len(b)
        self.short_ids = np.array([i for _, i in self.short], np.int64)
        self.short_low, self.short_high = (np.array([int.from_bytes(b.ljust(8, f), "big") for b, _ in self.short], np.uint64) for f in (b"\0", b"\xff"))
        self.long_ids = np.array([i for _, i in self.long], np.int64)
        self.long_head = np.array([int.from_bytes(b[:8], "big") for b, _ in self.long], np.uint64)
        tails = [b[8:16] for b, _ in self.long]
        self.long_low, self.long_high = (np.array([int.from_bytes(b.ljust(8, f), "big") for b in tails], np.uint64) for f in (b"\0", b"\xff"))
        self.rest = {i: b[16:] for b, i in self.long if len(b) > 16}
        shown = [bytes([m.bytes[i]]) if i in m.bytes else m.text.get(i, "").replace(_SPACE, " ").encode() for i in range(n)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(b) for b in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size

    def chunks(self, text: str) -> list[str]:
        """Runs of spaces stay with the word behind them."""
        return re.findall(r"[ ▁]+[^ ▁]*", " " + text) if text else []

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [c.replace(" ", _SPACE).encode() for c in chunks]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(lengths + 1) - lengths - 1
        data = np.frombuffer(b"\xff".join(parts) + b"\xff" * 64, np.uint8)
        start, end, piece = self._edges(data, int(begin[-1] + lengths[-1]) if len(parts) else 0)
        return self._relax(data, begin, lengths, start, end, piece)

    def _edges(self, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece in the suffix order of the characters."""
        chars = np.flatnonzero(((data[:n] & 0xC0) != 0x80) & (data[:n] != 0xFF))
        head, tail = _big_endian(data, chars), _big_endian(data, chars + 8)
        order = np.lexsort((tail, head))
        suffix, head, tail = chars[order], head[order], tail[order]

        low, high = np.searchsorted(head, self.short_low), np.searchsorted(head, self.short_high, "right")
        # longer pieces: first the range of equal heads, then the tails in it, by one search over (head, tail)
        groups, group_of = np.unique(head, return_inverse=True)
        at = np.minimum(np.searchsorted(groups, self.long_head), max(0, len(groups) - 1))
        hit = np.flatnonzero(groups[at] == self.long_head) if len(groups) else np.zeros(0, np.int64)
        first, last = np.searchsorted(group_of, at[hit]), np.searchsorted(group_of, at[hit], "right")
        long_low = [a + int(np.searchsorted(tail[a:b], x)) for a, b, x in zip(first, last, self.long_low[hit])]
        long_high = [a + int(np.searchsorted(tail[a:b], x, "right")) for a, b, x in zip(first, last, self.long_high[hit])]

        low, high = (np.concatenate([a, np.array(b, np.int64)]) for a, b in ((low, long_low), (high, long_high)))
        ids = np.concatenate([self.short_ids, self.long_ids[hit]])
        count = high - low
        piece = np.repeat(ids, count)
        start = suffix[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        if self.rest:  # what the sorted sixteen bytes leave open
            keep = np.ones(len(piece), bool)
            for k in np.flatnonzero(np.isin(piece, np.fromiter(self.rest, np.int64))).tolist():
                more = self.rest[int(piece[k])]
                keep[k] = data[start[k] + 16 : start[k] + 16 + len(more)].tobytes() == more
            start, piece = start[keep], piece[keep]
        # characters without a piece go over as bytes
        known = np.zeros(n + 1, bool)
        size = np.where(data[chars] < 0x80, 1, np.where(data[chars] < 0xE0, 2, np.where(data[chars] < 0xF0, 3, 4)))
        single = np.zeros(len(self.size), bool)
        single[[i for i, t in self.model.text.items() if len(t) == 1]] = True
        known[start[single[piece]]] = True
        lost = ~known[chars]
        end = np.concatenate([start + self.size[piece], (chars + size)[lost]])
        return np.concatenate([start, chars[lost]]), end, np.concatenate([piece, np.full(int(lost.sum()), _BYTES)])

    def _relax(self, data, begin, lengths, start, end, piece) -> tuple[np.ndarray, np.ndarray]:
        n = len(begin)
        last = np.full(len(data) + 1, -9, np.int64)
        came = np.zeros(len(data) + 1, np.int64)
        last[begin] = _START
        chunk = np.searchsorted(begin, start, "right") - 1
        depth = end - begin[chunk]
        order = np.argsort(depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
        width, valid = len(self.size) + 2, self.model.valid
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            pairs, back = np.unique((before + 2) * width + p + 2, return_inverse=True)
            ok = np.fromiter((valid(x // width - 2, x % width - 2) for x in pairs.tolist()), bool, len(pairs))[back] & (before != -9)
            last[e[ok]] = p[ok]
            came[e[ok]] = s[ok]
        # walk back from every chunk's end
        at, alive, steps = begin + lengths, np.arange(n), []
        alive = alive[lengths > 0]
        count = np.zeros(n, np.int64)
        while len(alive):
            here = at[alive]
            steps.append((alive, last[here], came[here], here))
            if (last[here] == -9).any():
                raise ValueError("a place that no piece reaches")
            count[alive] += 1
            at[alive] = came[here]
            alive = alive[came[here] > begin[alive]]
        if not steps:
            return count, np.zeros(0, np.uint32)
        who, what, frm, to = (np.concatenate(c) for c in zip(*steps))
        nth = np.concatenate([np.full(len(s[0]), k) for k, s in enumerate(steps)])
        order = np.lexsort((-nth, who))
        who, what, frm, to = who[order], what[order], frm[order], to[order]
        times = np.where(what == _BYTES, to - frm, 1)
        inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        ids = np.repeat(what, times)
        raw = ids == _BYTES
        ids[raw] = self.model.byte_ids[data[(np.repeat(frm, times) + inner)[raw]]]
        return np.bincount(np.repeat(who, times), minlength=n), ids.astype(np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.shown_size[ids]
        at = np.repeat(self.shown_start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.shown[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


def codec(path: str) -> PieceCodec:
    """One per worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids (u32, little endian)."""
    tune(docs.sparkSession)

    def run(it):
        c = codec(path)
        for b in batches(it):
            ids, counts = c.encode(b["text"])
            yield pa.record_batch({"doc_id": b["doc_id"], "n_pieces": pa.array(counts), "ids": pa.array([x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])], pa.binary())})

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids binary")


def decode(encoded: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, text of encode()'s rows; digest: the crc32 of ids and of the text in its place."""
    tune(encoded.sparkSession)

    def run(it):
        c = codec(path)
        for b in batches(it):
            texts = [c.decode(np.frombuffer(x, "<u4")) for x in b["ids"].to_pylist()]
            if digest:
                crc = lambda rows: pa.array([zlib.crc32(x) for x in rows], pa.int64())
                yield pa.record_batch({"doc_id": b["doc_id"], "n_pieces": b["n_pieces"], "ids_crc32": crc(b["ids"].to_pylist()), "text_crc32": crc(t.encode() for t in texts)})
            else:
                yield pa.record_batch({"doc_id": b["doc_id"], "text": pa.array(texts)})

    return encoded.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long" if digest else "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_pieces, and the crc32 of its ids and of the text decoded from them."""
    path = vocabulary_path("piece_bpe_32k.model")
    return decode(encode(read_table(spark, sf_dir, "documents"), path), path, digest=True)

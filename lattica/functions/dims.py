"""Vocabularies and rule tables of the graph domain.

Fixed values: results depend on these words, their spelling and, where noted, their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODE_TYPES = ["ui", "service", "database", "cache", "queue", "container"]
EDGE_LABELS = ["HTTP", "DB Query", "Async", "Cache"]
DEFAULT_TYPE, DEFAULT_LABEL = "service", "HTTP"
TYPE_ALIASES = {"data": "database", "db": "database", "worker": "service"}
MAX_NODES, MAX_EDGES = 10, 15

# The first word contained decides, so their order matters.
TYPE_WORDS = {
    "ui": "ui", "web": "ui", "frontend": "ui", "client": "ui", "portal": "ui", "dashboard": "ui",
    "database": "database", "postgres": "database", "mysql": "database", "mongodb": "database", "storage": "database", "db": "database",
    "redis": "cache", "cache": "cache",
    "kafka": "queue", "rabbitmq": "queue", "queue": "queue", "broker": "queue", "message": "queue",
    "container": "container", "docker": "container", "kubernetes": "container", "cluster": "container",
    "api": "service", "service": "service", "backend": "service",
}
LABEL_WORDS = {
    "http": "HTTP", "https": "HTTP", "rest": "HTTP", "request": "HTTP", "api": "HTTP", "grpc": "HTTP", "tcp": "HTTP",
    "db query": "DB Query", "db": "DB Query", "sql": "DB Query", "query": "DB Query", "database": "DB Query", "select": "DB Query",
    "async": "Async", "message": "Async", "event": "Async", "queue": "Async", "kafka": "Async", "publish": "Async", "subscribe": "Async",
    "cache": "Cache", "redis": "Cache", "cached": "Cache",
}
TYPE_LAYER = {"ui": "ui", "service": "service", "database": "data", "cache": "data", "queue": "service", "container": "service"}
ICONS = ["postgres", "redis", "kafka", "docker", "nginx", "react", "node", "aws"]
DASHED_LABELS = ["Async"]

# Control, risk, category, risk if missing, required for, description.
CONTROLS = [
    ("Authentication", "critical", "Identity and Access Management", "Unauthorized access to applications and sensitive data.", ["web_app", "api", "mobile_app", "admin_panel"], "Verifies the identity of users and services attempting to access systems."),
    ("RBAC", "critical", "Identity and Access Management", "Privilege escalation and unauthorized data modification.", ["web_app", "api", "admin_panel"], "Role-Based Access Control to enforce authorization policies strictly by roles."),
    ("API Gateway", "high", "Network Security", "Direct exposure of backend services, lack of throttling, and DoS attacks.", ["microservices", "api", "serverless"], "Acts as a single entry point for APIs, providing routing, rate limiting, and unified security."),
    ("Audit Logging", "high", "Observability and Compliance", "Inability to investigate security incidents and failure to meet compliance standards.", ["core", "financial", "healthcare", "admin_panel"], "Records continuous security-relevant events, operations, and access logs."),
    ("Monitoring", "medium", "Observability and Compliance", "Delayed detection of service degradation, system outages, or ongoing attacks.", ["infrastructure", "microservices", "web_app"], "Continuous monitoring of system health, real-time metrics, and security anomalies."),
    ("Secrets Manager", "critical", "Data Security", "Hardcoded credentials in code leading to complete application compromise.", ["backend", "microservices", "cicd_pipeline"], "Secure storage and dynamic access for API keys, passwords, and digital certificates."),
    ("SIEM", "high", "Security Operations", "Failure to correlate cross-system security events and detect complex breaches.", ["enterprise", "infrastructure"], "Security Information and Event Management system for log aggregation and active threat detection."),
    ("WAF", "high", "Network Security", "Application layer attacks such as SQL Injection (SQLi), XSS, and CSRF.", ["web_app", "api"], "Web Application Firewall designed to protect applications from common internet exploits."),
    ("IDS", "medium", "Network Security", "Unnoticed malicious activities and policy violations silently traversing the network.", ["infrastructure", "enterprise", "on_prem"], "Intrusion Detection System that continuously monitors network traffic for suspicious networking activity."),
    ("IPS", "high", "Network Security", "Inability to proactively drop malicious traffic before it reaches internal targets.", ["infrastructure", "enterprise", "on_prem"], "Intrusion Prevention System that actively blocks identified network threats in real-time."),
    ("Encryption Service", "critical", "Data Security", "Exposure of sensitive data at rest or in transit.", ["database", "storage", "microservices", "financial"], "Service providing robust cryptographic operations and secure key lifecycle management."),
    ("MFA", "critical", "Identity and Access Management", "Account compromise through credential stuffing, phishing, or password spraying.", ["web_app", "mobile_app", "admin_panel"], "Multi-Factor Authentication requiring multiple pieces of evidence to authenticate user sessions."),
]
RISK = {c[0]: c[1] for c in CONTROLS}
PENALTY = {"critical": 20, "high": 10, "medium": 5}

# Threat, severity, description.
THREATS = [
    ("Unauthorized Access", "CRITICAL", "Attackers can access systems or data without proper identity verification."),
    ("Privilege Escalation", "HIGH", "Users or attackers can gain higher access rights than they are supposed to have."),
    ("Credential Stuffing", "HIGH", "Automated injection of breached username/password pairs."),
    ("SQL Injection", "CRITICAL", "Attackers can execute malicious SQL statements that control a web application's database server."),
    ("Data Leakage", "CRITICAL", "Sensitive data is exposed in transit or at rest."),
    ("Data Tampering", "HIGH", "Data is maliciously modified."),
    ("DDoS", "HIGH", "Distributed Denial of Service attacking service availability."),
    ("Session Hijacking", "HIGH", "Attackers take over an active user session."),
    ("Insider Threat", "MEDIUM", "Malicious or negligent actions by internal users."),
    ("Log Evasion", "MEDIUM", "Attackers can perform actions without generating audit trails."),
    ("Lateral Movement", "HIGH", "Attackers move through the network searching for key assets."),
]
SEVERITY_LEVEL = {"CRITICAL": "danger", "HIGH": "warning", "MEDIUM": "info", "LOW": "success"}

# Threats of a missing control, in order.
CONTROL_THREATS = {
    "Authentication": ["Unauthorized Access", "Credential Stuffing"],
    "RBAC": ["Privilege Escalation", "Insider Threat"],
    "WAF": ["SQL Injection", "DDoS"],
    "Audit Logging": ["Log Evasion"],
    "Encryption Service": ["Data Leakage", "Data Tampering"],
    "Monitoring": ["Lateral Movement"],
    "API Gateway": ["DDoS", "Session Hijacking"],
    "MFA": ["Credential Stuffing", "Unauthorized Access"],
    "SIEM": ["Lateral Movement"],
}
# Words of the nodes that a missing control affects.
CONTROL_WORDS = {
    "WAF": ["api", "gateway", "service"],
    "API Gateway": ["api", "gateway", "service"],
    "Authentication": ["frontend", "ui", "client", "api", "service"],
    "MFA": ["frontend", "ui", "client", "api", "service"],
    "RBAC": ["api", "service", "admin"],
    "Encryption Service": ["database", "db", "storage", "postgres", "mysql", "mongo"],
    "Audit Logging": ["api", "service", "database", "db"],
    "Secrets Manager": ["api", "service", "backend"],
    "Monitoring": ["api", "service", "database", "db", "frontend", "ui"],
    "IDS": ["api", "service", "gateway"],
    "IPS": ["api", "service", "gateway"],
    "SIEM": ["api", "service", "database", "db"],
}
RECOMMENDATIONS = {
    "Authentication": "Add Authentication service to protect user access.",
    "RBAC": "Implement role-based access control.",
    "API Gateway": "Add API Gateway to secure and manage external traffic.",
    "WAF": "Deploy a Web Application Firewall.",
    "Audit Logging": "Enable centralized audit logging.",
    "Monitoring": "Add monitoring and observability.",
    "Encryption Service": "Encrypt sensitive data at rest and in transit.",
    "Secrets Manager": "Use a secrets management solution.",
    "SIEM": "Deploy a SIEM for security event aggregation and threat detection.",
    "IDS": "Implement an Intrusion Detection System.",
    "IPS": "Implement an Intrusion Prevention System.",
    "MFA": "Require Multi-Factor Authentication for user access.",
}
# Words of the baseline rules, of the domains, and what a domain requires.
FRONT, BACK, STORE, OPEN = "ui|frontend|client", "backend|service|api", "database|db|storage", "api|backend|public"
DOMAIN_WORDS = {
    "banking": "bank|finance|payment|transaction",
    "healthcare": "health|medical|patient|clinic",
    "cybersecurity": "cyber|security|threat|soc",
    "ecommerce": "ecommerce|shop|cart|retail|store",
    "microservices": "microservice|event bus|message queue",
    "web_application": "web|frontend|ui",
}
DOMAIN_CONTROLS = {
    "banking": ["MFA", "Encryption Service", "Audit Logging", "SIEM"],
    "healthcare": ["MFA", "Encryption Service", "Audit Logging"],
    "cybersecurity": ["SIEM", "IDS", "IPS", "Monitoring"],
    "ecommerce": ["Authentication", "RBAC", "WAF", "API Gateway"],
}
SURFACE = {"public_endpoints": "frontend|ui|public|api", "databases": "db|database|postgres|storage|redis", "services": "service|backend|api"}
# What a summary names, by the words of its nodes.
SUMMARY_PARTS = {"a frontend": "ui|frontend|client|react|app", "an API service": "api|backend|service", "a database": "db|database|postgres|storage"}

# Roles in subgraph extraction.
ENTRY_WORDS = ["api-gateway", "apigw", "load-balancer", "loadbalancer", "ingress", "gateway", "waf", "cdn", "proxy", "frontend", "front", "edge", "public", "web", "ui", "portal", "dashboard", "client", "app"]
DATA_WORDS = ["database", "storage", "postgres", "postgresql", "mysql", "mongo", "mongodb", "cosmos", "dynamo", "redis", "warehouse", "lake", "s3", "blob", "cache", "queue", "kafka", "rabbit", "message", "stream", "db"]
SECURITY_WORDS = ["waf", "iam", "auth", "oauth", "oidc", "mfa", "2fa", "vault", "kms", "secret", "rbac", "siem", "ids", "ips", "firewall", "zero-trust", "guard", "policy", "audit", "sso", "trust", "pki", "cert", "keycloak"]
TYPE_ROLE = {"ui": 6, "database": 6, "cache": 4, "queue": 4, "container": 2, "service": 1}
LABEL_WEIGHT = {"DB Query": 3, "Cache": 2, "Async": 2, "HTTP": 1}
SIZE_BUCKETS = [("b1_02_10", 2, 10), ("b2_11_20", 11, 20), ("b3_21_30", 21, 30), ("b4_31_50", 31, 50), ("b5_51_100", 51, 100), ("b6_101_plus", 101, 10**9)]
MARKERS = ["placeholder", "sample", "demo", "mock", "fake", "synthetic", "template", "dummy", "lorem", "test record", "example record", "filler", "xxx", "todo", "replace me", "insert", "generated by cyber"]


def controls(spark: SparkSession) -> DataFrame:
    """The control catalog as a dimension table."""
    return spark.createDataFrame(CONTROLS, "name string, risk_level string, category string, risk_if_missing string, required_for array<string>, description string")


def control_threats(spark: SparkSession) -> DataFrame:
    """control, threat, its place in the control's list, severity, severity_level."""
    severity = {t[0]: t[1] for t in THREATS}
    rows = [(c, t, i, severity[t], SEVERITY_LEVEL[severity[t]]) for c, ts in CONTROL_THREATS.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "control string, threat string, place int, severity string, severity_level string")


def values(rows: list[tuple]) -> str:
    """A SQL VALUES list of strings and numbers."""
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)

"""Secret scrubbing: a cheap guard, then seven ordered rules, each on what the one before it left. Hits are matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard and rules (name, pattern, replacement).
ANCHORS = ["eyJ", "AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "sk_", "rk_", "sk-", "-----BEGIN", "://", "hvs.", "hvb.", "hvr.", "pypi-"]
KEYWORDS = ["password", "passwd", "secret", "token", "api_key", "access_key", "private_key", "auth_token", "client_secret", "credential", "bearer"]
_VALUE = r"""('[^']*'|"(?:[^"\\]|\\.)*"|[^\s]+)"""
RULES = [
    ("pem_private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    ("token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bAIza[0-9A-Za-z_\-]{35}\b|\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{22,}\b|\bxox[baprs]-[A-Za-z0-9-]{10,}\b|\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b|\bsk-(?:ant-)?[A-Za-z0-9_\-]{20,}\b|\bhv[sbr]\.[A-Za-z0-9_-]{20,}\b|\bpypi-[A-Za-z0-9_-]{16,}\b", "[REDACTED]"),
    ("authorization_header", r"(?i)(authorization\s*[:=]\s*[A-Za-z][A-Za-z0-9._-]*\s+)\S+", "$1[REDACTED]"),
    ("secret_flag_value", r"(?i)(--(?:password|passwd|pwd|secret|token|auth[_-]?token|access[_-]?token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|credential|credentials)\s+)" + _VALUE, "$1[REDACTED]"),
    ("url_userinfo", r"([a-zA-Z][a-zA-Z0-9+.\-]*://[^\s:/@]+:)[^\s@/]+(@)", "$1[REDACTED]$2"),
    ("secret_assignment", r"(?i)((?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?token|client[_-]?secret)\s*[:=]\s*)" + _VALUE, "$1[REDACTED]"),
    ("database_url", r"(?i)(postgres|mysql|mongodb)://([^@\s]+)@", "[REDACTED:db_credentials]@"),
]


def may_hold_secret(s: Column) -> Column:
    """The guard; texts it refuses pass unread, also where their only trigger is one it lacks."""
    low, out = F.lower(s), F.lit(False)
    for a in ANCHORS:
        out = out | s.contains(a)
    for k in KEYWORDS:
        out = out | low.contains(k)
    return out


def scrubbed(s: Column) -> Column:
    out = s
    for _, pattern, replacement in RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(may_hold_secret(s), out).otherwise(s)


def hits(s: Column) -> Column:
    """name -> matches of each rule on what the rules before it left."""
    left, out = s, []
    for name, pattern, replacement in RULES:
        out += [F.lit(name), F.when(may_hold_secret(s), F.regexp_count(left, F.lit(pattern))).otherwise(0)]
        left = F.regexp_replace(left, pattern, replacement)
    return F.create_map(*out)


def scrub_list(args: Column) -> Column:
    return F.transform(args, scrubbed)

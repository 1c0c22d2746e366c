"""Scan for secrets: an Aho-Corasick automaton finds keywords, anchored regular expressions run only at its hits, and what
they match must pass the check its kind of secret embeds (CRC-32 in base 62, the Luhn digit, a decodable header, or enough
entropy where there is none).

Offsets count characters of the text. Of overlapping findings the one of the earlier rule stays, then the earlier, then the
longer. Keywords are found in any letter case of ASCII; regular expressions say what case they want.

Defined cases: a null text has no finding and stays null; a null doc_id is reported as null; repeated rows are reported
each; whole texts are scanned, however long; other columns are ignored by ``find_secrets`` and passed on by
``redact_secrets``; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(body: str) -> str:
    """CRC-32 of ``body`` as six digits in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def has_crc(value: str) -> bool:
    body = value.split("_", 1)[1]
    return crc_suffix(body[:-6]) == body[-6:]


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def jwt_header(value: str) -> bool:
    try:
        head = value.split(".")[0]
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False


@dataclass(frozen=True)
class Rule:
    """``pattern`` must match at ``back`` characters or fewer before a keyword; its group "s", or all of it, is the secret."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[str], bool]
    back: int = 0


#: To its END, with header lines; without END, the known header lines and the lines of base64 that follow, the last of any length if it stands alone.
GAP = r"(?:\s|\\[rnt])*+"
PRIVATE_KEY = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:"
    rf"(?:{GAP}[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)*+[A-Za-z0-9+/=\s\\]*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    rf"|(?:{GAP}(?:Proc-Type|DEK-Info|Content-Domain|Key-Info|MIC-Info|Comment|Subject|Version|(?:Originator|Recipient|X)-[A-Za-z-]+):[^\r\n\\]*+)*+"
    rf"(?:{GAP}[A-Za-z0-9+/=]{{40,}}+)*+(?:{GAP}[A-Za-z0-9+/=]++(?=[ \t]*(?:[\r\n\\\"'`<]|$)))?+)"
)

#: Digits in a row, or in the groups in which cards show them, with one kind of separator.
CARD = re.compile(r"(?<![\d.])(?:(?:4\d{3}|5[1-5]\d\d|6(?:011|5\d\d))([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d\d([ -]?)\d{6}\2\d{5})(?![\d.]*\d)")

RULES = (
    Rule("private_key", ("-----begin",), PRIVATE_KEY, lambda v: True),
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), has_crc),
    Rule("npm_token", ("npm_",), re.compile(r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), has_crc),
    Rule("aws_key_id", ("akia", "asia"), re.compile(r"(?<![A-Za-z0-9])A(?:KI|SI)A[A-Z2-7]{16}(?![A-Za-z0-9])"), lambda v: entropy(v[4:]) >= 2.5),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[bpars]-[0-9A-Za-z-]{20,}"), lambda v: entropy(v[5:]) >= 3.0),
    Rule("stripe_key", ("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,}"), lambda v: entropy(v[8:]) >= 3.0),
    Rule("google_key", ("aiza",), re.compile(r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), lambda v: entropy(v[4:]) >= 3.5),
    Rule("jwt", ("eyj",), re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"), jwt_header),
    Rule(
        "assigned_secret",
        ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "credential"),
        re.compile(
            r"(?i)(?:token|secret|password|passwd|api[_-]?key|access_key|credentials?)[A-Za-z0-9_]{0,20}[\"']?\s{0,3}(?:=|:=|=>|:)\s{0,3}"
            r"(?P<q>[\"'])?(?P<s>(?(q)(?!\[\w+\])[^\s\"']{16,}+|(?!=)[A-Za-z0-9+/=_.~!@#%^*-]{16,}+))(?(q)(?P=q)|(?=[\s,;&\"'<]|$))"
        ),
        lambda v: entropy(v) >= 3.0,
    ),
    Rule("payment_card", ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65"), CARD, luhn),
)
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, rule in enumerate(RULES):
            for word in rule.keywords:
                by.setdefault(word, []).append(k)
        for word, rules in by.items():
            _automaton.add_word(word, (len(word), tuple(rules)))
        _automaton.make_automaton()
    return _automaton


def lowered(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def scan(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, rule, secret) of what is found in ``text``, in order."""
    if not text:
        return []
    found: set[tuple[int, int, int]] = set()
    for end, (n, rules) in automaton().iter(lowered(text)):
        start = end - n + 1
        for k in rules:
            for at in range(max(0, start - RULES[k].back), start + 1):
                if (m := RULES[k].pattern.match(text, at)) is not None:
                    a, b = m.span("s") if "s" in RULES[k].pattern.groupindex else m.span()
                    if RULES[k].valid(text[a:b]):
                        found.add((k, a, b))
                    break
    if not found:
        return []
    taken: list[tuple[int, int, int]] = []
    for k, a, b in sorted(found, key=lambda f: (f[0], f[1], -f[2])):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, k))
    return [(a, b, RULES[k].name, text[a:b]) for a, b, k in sorted(taken)]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows += [(doc_id, rule, a, b, hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()) for a, b, rule, s in scan(text)]
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "rule", "start", "end", "sha256"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, start, end, sha256) of every secret; the secret itself is not repeated."""
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, "doc_id long, rule string, start int, end int, sha256 string")


def redact(text: str | None) -> str | None:
    found = scan(text)
    if not found:
        return text
    out, at = [], 0
    for a, b, rule, _ in found:
        out += [text[at:a], f"[{rule}]"]
        at = b
    return "".join(out) + text[at:]


def _redact(text: int, chars: int | None):
    """``text`` and ``chars``: places of these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                old = part.column(text).to_pylist()
                new = [redact(t) for t in old]
                if any(x is not y for x, y in zip(old, new)):
                    columns = list(part.columns)
                    columns[text] = pa.array(new, part.schema.field(text).type)
                    if chars is not None:
                        counts = part.column(chars).to_pylist()
                        columns[chars] = pa.array([n if x is y else len(y) for n, x, y in zip(counts, old, new)], part.schema.field(chars).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return run


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret in the column text replaced by the name of its rule in brackets, and n_chars, if there is such a column, counted again where the text changed."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names of any characters
    return plain.mapInArrow(_redact(names.index("text"), names.index("n_chars") if "n_chars" in names else None), plain.schema).toDF(*names)

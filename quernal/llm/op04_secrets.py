"""Secret scans: an Aho-Corasick prefilter, anchored expressions near its hits, then embedded checksums.

One automaton of all rules' keywords runs over the bytes of a block of texts, ASCII letters in small letters. Only at a hit is the rule's
expression tried, anchored at the keyword (`before` bytes ahead of it at most), never over the whole text. What it matches is checked:

* GitHub and npm tokens end in six base-62 digits of the CRC-32 of what precedes them;
* an AWS key id's letters after its prefix are base 32 and hold an account number of twelve digits at most;
* a JSON web token's first part is base64url of a JSON object with "alg";
* a PyPI token is base64 that begins with a macaroon of pypi.org;
* a PEM private key's body is base64, and if DER its outer length fits; its line ends may be escaped, as in JSON;
* a value assigned to a name like token, secret, password or api_key has no checksum; it counts if it has LEAST_BITS bits of Shannon entropy a character over
  16 characters or more, and both letters and digits.

A result row has doc_id, rule, start (code points, from 0), length, checksum ('valid', 'none' where the kind has none, and 'invalid'), and fingerprint,
the SHA-256 of the secret, never the secret. Matches with a failed checksum are reported as 'invalid' and left in the text by `redact`. Where
findings overlap the one that begins first stays, then the longest, then the first rule; but an 'invalid' one gives way to any other that overlaps it.

Names, values, tokens and key bodies may be of any length. A try costs time linear in what follows the hit, so a long value that is full of keywords
costs its length times their number.

Defined cases: null and empty texts have no findings; null doc_ids are carried through; repeated rows are scanned each for itself; an
empty table gives an empty result. `redact` replaces valid and checksum-less findings by [SECRET:rule] and keeps all
rows and columns; where docs has a column n_chars of whole numbers that gives the text's length, it follows the new text.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernal.llm.words import Block, blocks
from quernal.session import ship

LEAST_BITS = 3.0
_B62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 6) -> bytes:
    out = b""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r : r + 1] + out
    return out.rjust(width, b"0")


def _crc(secret: bytes) -> str:
    body = secret.rpartition(b"_")[2]
    return "valid" if base62(zlib.crc32(body[:-6])) == body[-6:] else "invalid"


def _aws(secret: bytes) -> str:
    try:
        raw = base64.b32decode(secret[4:])
    except binascii.Error:
        return "invalid"
    return "valid" if (int.from_bytes(raw[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12 else "invalid"


def _jwt(secret: bytes) -> str:
    head = secret.split(b".")[0]
    try:
        x = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except ValueError:
        return "invalid"
    return "valid" if isinstance(x, dict) and "alg" in x else "invalid"


def _pypi(secret: bytes) -> str:
    body = secret[5:]
    try:
        raw = base64.urlsafe_b64decode(body + b"=" * (-len(body) % 4))
    except ValueError:
        return "invalid"
    return "valid" if b"pypi.org" in raw[:16] else "invalid"


def _pem(secret: bytes) -> str:
    lines = [x.strip() for x in re.sub(rb"\\+[rn]", b"\n", secret).splitlines()[1:-1] if x.strip() and b":" not in x]
    try:
        raw = base64.b64decode(b"".join(lines), validate=True)
    except ValueError:
        return "invalid"
    if raw[:1] != b"\x30":
        return "valid" if raw.startswith(b"openssh-key-v1") or len(raw) >= 32 else "invalid"
    n = raw[1] & 0x7F if len(raw) > 1 and raw[1] & 0x80 else 0
    size = int.from_bytes(raw[2 : 2 + n], "big") if n else raw[1] if len(raw) > 1 else -1
    return "valid" if size + 2 + n == len(raw) else "invalid"


def _entropy(secret: bytes) -> str:
    n = len(secret)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(secret).values())
    return "none" if bits >= LEAST_BITS and re.search(rb"[0-9]", secret) and re.search(rb"[A-Za-z]", secret) else "no"


@dataclass(frozen=True)
class Rule:
    """words: keywords in small letters; pattern: anchored where the keyword begins; group 1, if there is one, is the secret."""

    name: str
    words: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    check: Callable[[bytes], str]
    edge: bool = True


_END = rb"(?![A-Za-z0-9_-])"
RULES = (
    Rule("github-token", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}" + _END), _crc),
    Rule("github-fine-grained", (b"github_pat_",), re.compile(rb"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}" + _END), lambda s: "none"),
    Rule("npm-token", (b"npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}" + _END), _crc),
    Rule("gitlab-token", (b"glpat-",), re.compile(rb"glpat-[A-Za-z0-9_-]{20,}+"), lambda s: "none"),
    Rule("aws-access-key", (b"akia", b"asia"), re.compile(rb"(?:AKIA|ASIA)[A-Z2-7]{16}" + _END), _aws),
    Rule("google-api-key", (b"aiza",), re.compile(rb"AIza[A-Za-z0-9_-]{35}" + _END), lambda s: "none"),
    Rule("slack-token", (b"xoxb-", b"xoxp-", b"xoxa-", b"xoxr-", b"xoxs-"), re.compile(rb"xox[baprs]-[A-Za-z0-9-]{20,}+" + _END), lambda s: "none"),
    Rule("stripe-key", (b"sk_live_", b"rk_live_", b"sk_test_"), re.compile(rb"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}+" + _END), lambda s: "none"),
    Rule("pypi-token", (b"pypi-",), re.compile(rb"pypi-[A-Za-z0-9_-]{50,}+"), _pypi),
    Rule("json-web-token", (b"eyj",), re.compile(rb"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{16,}+"), _jwt),
    Rule("private-key", (b"-----begin",), re.compile(rb"-----BEGIN ([A-Z]{0,12} ?)PRIVATE KEY-----[A-Za-z0-9+/=\s:,\\-]{32,}?-----END \1PRIVATE KEY-----"), _pem, edge=False),
    Rule("assigned-secret", (b"token", b"secret", b"password", b"passwd", b"api_key", b"apikey", b"api-key", b"access_key", b"auth_key", b"private_key"), re.compile(rb"""[A-Za-z_-]{5,}+["']?[ \t]*+(?:=|:|:=|=>)[ \t]*+["']?([A-Za-z0-9+/_.=~-]{16,}+)"""), _entropy, edge=False),
)
WHOLE = {"private-key"}
_FIELDS = [("rule", T.StringType()), ("start", T.IntegerType()), ("length", T.IntegerType()), ("checksum", T.StringType()), ("fingerprint", T.StringType())]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, r in enumerate(RULES):
        for w in r.words:
            a.add_word(w.decode("latin-1"), (k, len(w)))
    a.make_automaton()
    return a


_made: list[ahocorasick.Automaton] = []


def attempt(rule: Rule, data: bytes, at: int, end: int) -> tuple[int, int, str] | None:
    """What the rule finds at byte `at` of the text data[..end]: start and end of the secret, and its checksum's state."""
    if rule.edge and at and re.match(rb"[A-Za-z0-9_]", data[at - 1 : at]):
        return None
    m = rule.pattern.match(data, at, end)
    if not m:
        return None
    a, b = m.span(1) if m.re.groups and rule.name not in WHOLE else m.span()
    state = rule.check(data[a:b])
    return None if state == "no" else (a, b, state)


def _first(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    out: list[tuple[int, int, int, str]] = []
    for x in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def resolve(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Of overlapping (start, end, rule, state) the first, longest, earliest rule; one with a failed checksum only where no other overlaps it."""
    good = _first([x for x in found if x[3] != "invalid"])
    ends = [x[1] for x in good]

    def free(x: tuple[int, int, int, str]) -> bool:
        k = bisect.bisect_right(ends, x[0])
        return k == len(good) or good[k][0] >= x[1]

    return sorted(good + [x for x in _first([x for x in found if x[3] == "invalid" and free(x)])])


def scan(block: Block) -> dict[int, list[tuple[int, int, int, str]]]:
    """By row of the block: findings (start, end, rule, state) at byte positions in the block."""
    if not _made:
        _made.append(automaton())
    data = block.data.tobytes()
    offs = block.offsets.tolist()
    raw: dict[int, list[tuple[int, int, int, str]]] = {}
    for last, (k, size) in _made[0].iter(data.lower().decode("latin-1")):
        at = last + 1 - size
        row = bisect.bisect_right(offs, at) - 1
        if last >= offs[row + 1]:
            continue
        # texts adjoin in the block, so what lies before this one mustn't count as its edge
        text_at = offs[row]
        if RULES[k].edge and at == text_at:
            m = attempt(RULES[k], data[text_at : offs[row + 1]], 0, offs[row + 1] - text_at)
            m = m and (m[0] + text_at, m[1] + text_at, m[2])
        else:
            m = attempt(RULES[k], data, at, offs[row + 1])
        if m:
            raw.setdefault(row, []).append((m[0], m[1], k, m[2]))
    return {row: resolve(x) for row, x in raw.items()}


def _points(block: Block, row: int, a: int, b: int) -> tuple[int, int]:
    start = block.data[block.offsets[row] : a]
    inner = block.data[a:b]
    return int(np.count_nonzero((start & 0xC0) != 0x80)), int(np.count_nonzero((inner & 0xC0) != 0x80))


def _found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows, out = [], []
        for x in blocks(b.column(1)):
            for row, found in scan(x).items():
                for a, e, k, state in found:
                    rows.append(row + x.first)
                    out.append((RULES[k].name, *_points(x, row, a, e), state, hashlib.sha256(x.data[a:e].tobytes()).hexdigest()))
        if rows:
            cols = list(zip(*out, strict=True))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *(n for n, _ in _FIELDS)])


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, rule, start, length, checksum, fingerprint: a row for each secret found."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, t) for n, t in _FIELDS)])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_found, schema)


@F.arrow_udf(T.StringType())
def _clean(text: pa.Array) -> pa.Array:
    changed: dict[int, str] = {}
    for x in blocks(text):
        for row, found in scan(x).items():
            parts, at = [], int(x.offsets[row])
            for a, e, k, state in found:
                if state != "invalid":
                    parts += [x.data[at:a].tobytes(), f"[SECRET:{RULES[k].name}]".encode()]
                    at = e
            if parts:
                changed[row + x.first] = b"".join([*parts, x.data[at : x.offsets[row + 1]].tobytes()]).decode("utf-8", "replace")
    if not changed:
        return text
    out = text.to_pylist()
    for k, t in changed.items():
        out[k] = t
    return pa.array(out, pa.string())


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in `text` replaced; all rows and columns stay."""
    ship(docs.sparkSession)
    columns = docs.columns
    out = docs.withColumn("text", _clean(docs["text"].cast("string")))
    if "n_chars" in columns and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)):
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull() & F.col("n_chars").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*columns)

"""Operator 10: secrets, by pattern and by token efficiency.

Text of people and programs costs a byte-pair vocabulary about four characters a token; random
strings cost about two or fewer.  Unbroken strings that fall below a ratio are reported, whether
or not a pattern has them too, unless they are known: numbers, identifiers by their shape, and
digests by the name that stands before them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_frames, table

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
#: Candidates for the token test.
STRING = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Characters per token below which a string of mixed characters counts as random.
RATIO = 2.4
#: The same for strings of letters alone, which must be longer: words of any language can be rare.
LETTER_RATIO, LETTERS = 2.0, 24
#: Shapes that are random by nature but no secrets: identifiers, numbers, and digests with the name of their algorithm.
KNOWN = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|(md5|sha1|sha224|sha256|sha384|sha512)[-_=][A-Za-z0-9+/=]+", re.I)
#: Names that make the string behind them a known digest or identifier.
NAMED = re.compile(r"(md5|sha-?[0-9]{0,3}|digest|checksum|hash|commit|revision|etag|fingerprint|uuid|guid)[^A-Za-z0-9]{1,4}\Z", re.I)
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("spans", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by start, then kind."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda x: (x[1], x[0]))


def is_mixed(s: str) -> bool:
    """Digits and letters, or letters of both cases turning often: prose in one piece is neither."""
    has_digit, has_alpha = any(c.isdigit() for c in s), any(c.isalpha() for c in s)
    turns = sum(a.isupper() != b.isupper() for a, b in zip(s, s[1:], strict=False))
    return has_alpha and (has_digit or turns >= len(s) / 5)


def random_spans(text: str, enc, ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for m in STRING.finditer(text):
        s = m[0]
        mixed = is_mixed(s)
        if not mixed and len(s) < LETTERS or KNOWN.fullmatch(s) or NAMED.search(text, max(0, m.start() - 24), m.start()):
            continue
        if len(s) < (ratio if mixed else min(ratio, LETTER_RATIO)) * len(enc.encode_ordinary(s)):
            out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(path: str, ratio: float, full: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.doc_id, b.text, strict=True):
                base = base_spans(text)
                every = sorted(base + random_spans(text, enc, ratio), key=lambda x: (x[1], x[0]))
                if full:
                    rows += [(doc, KINDS[k], s, e, text[s:e]) for k, s, e in every]
                else:
                    counts = [sum(k == n for k, _, _ in base) for n in range(3)]
                    rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            names = ["doc_id", "kind", "start", "end", "secret"] if full else ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def secret_spans(docs: DataFrame, path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """One row for each secret: doc_id, kind, start, end (code points, end exclusive), secret.

    A null text has none; a null doc_id stays null; strings of one place and several kinds are
    reported for each, random strings too; repeated rows are reported as often as they occur;
    whole texts are read, however long; other columns are ignored; an empty table gives no rows.
    """
    return map_frames(documents(docs), _scan(path or vocabulary_path(), ratio, True), "doc_id long, kind string, start int, end int, secret string")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of each row of ``documents``, also of rows without any."""
    return map_frames(documents(table(spark, sf_dir, "documents")), _scan(vocabulary_path(), RATIO, False), RESULT)

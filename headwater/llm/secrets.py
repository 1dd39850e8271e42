"""Secret scans: fixed credential patterns, and random strings shown by their token efficiency.

A random string splits into many short pieces under a byte-level BPE vocabulary, so it has few characters a token.
Candidates are long runs of key characters; known digests and identifiers are excluded before they are encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

#: The patterns, the kinds in their order, the least lengths.
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Letter lengths of common digests in hexadecimal: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: Parts of a name, and words of two letters.
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SHORT_WORDS = frozenset("ad am an as at be by db do eu go he hi id if in io ip is it js me my no of ok on or os pi pk py so to tv ui uk up us vs we".split())
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _either(word: str) -> str:
    return "".join(f"[{ch.upper()}{ch}]" if ch.isalpha() else ch for ch in word)


ASSIGN = re.compile("(?:" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Every access key and every hexadecimal string of the least length lies in a run of these.
RUN = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping within a kind; offsets in code points, end exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    for run in RUN.finditer(text):
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text, run.start(), run.end()) if m.end() - m.start() >= MIN_ACCESS]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= MIN_HEX]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def is_known(run: str, encode) -> bool:
    """A digest, or an identifier: a UUID, short numbers between marks (dates, telephone numbers), a stretch of the alphabet, digits that count up, or a name that splits into words (camel case, snake case, paths)."""
    bare = run.strip("=-_/+")
    if UUID.fullmatch(bare):
        return True
    if len(bare) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare):
        return True
    if re.fullmatch(r"(?:[0-9]{0,8}[=_/+-]+)*[0-9]{0,8}", bare) or bare.lower() in ALPHABET or (bare.isdigit() and all((int(y) - int(x)) % 10 == 1 for x, y in zip(bare, bare[1:], strict=False))):
        return True
    return bool(re.fullmatch(r"[A-Za-z_/=+-]+[0-9]{0,4}", bare)) and splits_into_words(bare, encode)


def splits_into_words(name: str, encode) -> bool:
    """Each part is a word, and words of three letters or more make up half the letters at least. A word is one token of the vocabulary, in small letters, alone or behind a space; of one or two letters, a letter or one of SHORT_WORDS."""
    parts = [p.lower() for p in PART.findall(name)]
    long = [p for p in parts if len(p) > 2]
    if 2 * sum(map(len, long)) < sum(map(len, parts)):
        return False
    return all(p in SHORT_WORDS for p in parts if len(p) == 2) and all(len(encode(" " + p)) == 1 or len(encode(p)) == 1 for p in long)


def random_spans(text: str, encode, max_ratio: float, covered: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs whose characters a token are at most max_ratio, beside known strings and spans found already."""
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        if any(a <= s and e <= b for _, a, b in covered) or is_known(m[0], encode):
            continue
        if len(m[0]) <= max_ratio * len(encode(m[0])):
            out.append(("random", s, e))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.2, vocabulary: str | None = None, redact: bool = False) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_random, base_sha256, spans, and `redacted` if asked for.

    Null texts count as empty, null ids stay null, repeated rows give repeated results, other columns are not read.
    No shuffle: each text is scanned whole where it is read.
    """
    path = c.tokenizer_file("byte_bpe_50k.tiktoken", vocabulary)
    spec = "id {}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string" + ", redacted string" * redact
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = c.kept(("tiktoken", path), lambda: c.tiktoken_encoding(path))
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                every = sorted(base + random_spans(text, enc.encode_ordinary, max_ratio, base), key=lambda s: (s[1], KINDS.index(s[0])))
                n = [sum(s[0] == k for s in every) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), *([redacted(text, every)] * redact)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (6 + redact)
            types = [pa.int64()] * 4 + [pa.string()] * (2 + redact)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", *["redacted"] * redact])

    return c.map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, spec.format(id_type.simpleString())).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for s, e in merged(spans):
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, max_ratio: float = 2.2, vocabulary: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose texts have a mark in place of each secret; length_col, if named, is the new text's length. Null texts stay null. Nothing moves."""
    path = c.tokenizer_file("byte_bpe_50k.tiktoken", vocabulary)
    at = docs.columns.index(text_col)
    also = docs.columns.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = c.kept(("tiktoken", path), lambda: c.tiktoken_encoding(path))
        for b in batches:
            texts, sizes = b.column(at).to_pylist(), b.column(also).to_pylist() if also is not None else []
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    if every := base + random_spans(text, enc.encode_ordinary, max_ratio, base):
                        texts[i] = redacted(text, every)
                        if also is not None:
                            sizes[i] = len(texts[i])
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.column(at).type))
            yield b.set_column(also, b.schema.field(also), pa.array(sizes, b.column(also).type)) if also is not None else b

    return c.map_arrow(docs, run, docs.schema)

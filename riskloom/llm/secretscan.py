"""Secret scans: patterns with fixed spans, and strings that a primed compressor can't predict.

A candidate of the second kind is a long mixed string behind a sensitive word, or in a PEM private key. Its novelty is its
marginal size: the bytes that zstandard needs for it, primed with a raw dictionary of the code around it (without any copy
of the candidate) and of common identifiers, less the bytes for nothing, as a share of the bytes that random characters of its
alphabet need. Ordinary identifiers and paths cost few bytes; keys cost nearly all their bits. A key that stands
again nearby is reported too, as one of the kind repeated: with its copies its document foretells it, without them it doesn't.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, raw_strings

# The patterns of the three base kinds, and the least lengths of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "novel", "repeated")

#: Words whose neighbourhood makes a long string a candidate, and what may stand before them in one.
WORDS = "private access authorization authentication auth bearer cookies cookie credentials credential encryption keys key login passphrase passcode passwords password passwd pass pin pwd salt secrets secret sessions session signature signing tokens token webhooks webhook"
BEFORE = "api ssh aws gpg pgp user"
#: A word begins where no letter stands before it (or, in camel case, with a capital behind a small letter) and goes on in no small letter: a monkey and a keyboard are none.
SENSITIVE = re.compile(rf"(?<![A-Za-z])(?i:(?:{BEFORE.replace(' ', '|')})?(?:{WORDS.replace(' ', '|')})+)(?![a-z])|(?<=[a-z0-9])(?:{WORDS.title().replace(' ', '|')})(?![a-z])", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
#: The dictionary of identifiers that code and settings use.
IDENTIFIERS = (
    "abstract access account address admin application argument array async auth authorization await backend base64 bearer boolean "
    "branch buffer bucket bundle callback catch channel class client cluster column commit component config configuration connection "
    "const constructor container content context controller cookie count create credentials database debug default define delete "
    "deploy description development directory document domain element email encoding endpoint environment error event example "
    "exception execute export extends factory false field file filter float format frontend function generate global handler hash "
    "header hidden host hostname http https identifier implements import index initialize input instance integer interface internal "
    "iterator json key lambda language length library list local localhost logger login main manager message method middleware model "
    "module mutable namespace network node null object options order output package parameter parse password path pattern payload "
    "permission pipeline plugin port primary private process production profile project promise property protected protocol provider "
    "public query queue random read record redirect reference region register release remote render repository request resource "
    "response result return role route schema scheduler script secret security self server service session settings signature source "
    "static status storage stream string struct super table target task template test throw timeout timestamp token transaction "
    "transform true type undefined update upload user username utils validate value variable version virtual void webhook while "
    "window worker write abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 _id _key _name .com .org www. "
)
#: The inside of a PEM private key, to its end line or the end of the text, and the lines of its body.
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END|\Z)", re.DOTALL)
PEM_LINE = re.compile(r"^[\x20\t]*([A-Za-z0-9+/]+=*)[\x20\t\r]*$", re.MULTILINE)
#: A candidate's sensitive word stands at most so many characters before it, runs of space and line ends counting one; so many bytes around it prime the compressor.
NEAR, AROUND, NOVELTY = 48, 2048, 0.72
#: Runs of text without any of these hold no match of ACCESS; runs of 24 hexadecimal digits are looked for after a translation.
_HEX = bytes(ord("h") if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))

Span = tuple[int, int, int, float]  # start, kind, end, novelty


def base_spans(text: str, hexes: bool = True) -> list[Span]:
    """The spans (code points, end exclusive) of the three base kinds: leftmost, non-overlapping per kind; short ones dropped."""
    out = [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if hexes:
        out += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return out


def alphabet(candidate: bytes) -> bytes:
    """The characters that a random string like candidate has: hexadecimal digits of one case, or the classes that occur."""
    for digits in (b"0123456789abcdef", b"0123456789ABCDEF"):
        if not candidate.strip(digits):
            return digits
    kinds = (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"+/_.=~-")
    return b"".join(k for k in kinds if any(c in k for c in candidate)) or kinds[0]


def marginal(candidate: bytes, around: bytes) -> int:
    """Marginal compressed bytes of candidate, with around and the identifiers as a raw dictionary."""
    import zstandard as zstd

    primed = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(IDENTIFIERS.encode() + around, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    return len(primed.compress(candidate)) - len(primed.compress(b""))


@lru_cache(maxsize=4096)
def random_size(characters: bytes, n: int) -> int:
    """Marginal compressed bytes of n random characters: their entropy, as far as the compressor gets there; n at most."""
    rng = random.Random(n)
    return max(1, min(n, marginal(bytes(rng.choices(characters, k=n)), b"")))


def novelty(candidate: bytes, around: bytes) -> float:
    """Marginal compressed bytes of candidate, against those of random characters of its alphabet."""
    return marginal(candidate, around) / random_size(alphabet(candidate), len(candidate))


def novel_spans(text: str, taken: list[Span], least: float = NOVELTY) -> list[Span]:
    """Incompressible strings in a sensitive context that no span of taken overlaps; those that are so but for copies nearby are repeated."""
    out = []
    held = sorted((s, e) for s, _, e, _ in taken)
    inside = [m.span(1) for m in PEM.finditer(text)] if "PRIVATE KEY" in text else []
    found = {m.span(): False for m in CANDIDATE.finditer(text)}
    for a, b in inside:  # lines of a key's body, whatever their length and characters
        lines = [m.span(1) for m in PEM_LINE.finditer(text[a:b])]
        found |= {(a + s, a + e): True for s, e in lines}
    for (s, e), body in sorted(found.items()):
        word = text[s:e]
        if not body and (not (re.search(r"[0-9]", word) and re.search(r"[A-Za-z]", word)) or word.count(".") > 3):
            continue
        near = body or any(a <= s < b for a, b in inside) or SENSITIVE.search(" ".join(re.split(r"\s+", text[max(0, s - 4 * NEAR) : s]))[-NEAR:])
        if not near or any(a < e and s < b for a, b in held):
            continue
        before, after = text[max(0, s - AROUND) : s], text[e : e + AROUND]
        around = before + after
        if word in around:
            alone = novelty(word.encode(), (before.replace(word, " ") + after.replace(word, " ")).encode("utf-8", "replace"))
            if alone < least:
                continue
            score = novelty(word.encode(), around.encode("utf-8", "replace"))
            out.append((s, 3, e, score) if score >= least else (s, 4, e, alone))
            continue
        score = novelty(word.encode(), around.encode("utf-8", "replace"))
        if score >= least:
            out.append((s, 3, e, score))
    return out


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(spans))


def scan_text(text: str, hexes: bool = True, candidates: bool = True) -> tuple[list[Span], list[Span]]:
    base = base_spans(text, hexes)
    return base, novel_spans(text, base) if candidates else []


_LONG = bytes(ord("c") if re.match(CANDIDATE.pattern[: CANDIDATE.pattern.index("{")], chr(c)) else 0x20 for c in range(128)) + bytes([0x20] * 128)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text; more columns are ignored): numbers of base spans, their digest, and all spans.

    Null or empty text has no spans. Rows that repeat are scanned each. Returns doc_id, n_assign, n_access, n_hex,
    base_sha256 (of the base spans as kind:start:end by start and kind, comma-joined), spans (the same form, all of them: with the kinds
    novel and repeated), n_novel (repeated ones left out), and found: an array of (kind, start, end, string, novelty).
    """
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("string", pa.string()), ("novelty", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64()), ("found", found)])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets, 4 << 20):
                b = batch.slice(lo, hi - lo)
                rows = []
                for text in b.column("text").to_pylist():
                    if not text:
                        rows.append((0, 0, 0, nothing, "", 0, []))
                        continue
                    raw = text.encode("utf-8", "replace")
                    base, novel = scan_text(text, b"h" * LEAST["hex"] in raw.translate(_HEX), b"c" * 16 in raw.translate(_LONG))
                    n = [sum(k == i for _, k, _, _ in base) for i in range(3)]
                    every = sorted(base + novel)
                    rows.append((*n, hashlib.sha256(said(base).encode()).hexdigest(), said(every), sum(k == 3 for _, k, _, _ in novel), [{"kind": KINDS[k], "start": s, "end": e, "string": text[s:e], "novelty": v} for s, k, e, v in every]))
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    out = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint, found array<struct<kind:string,start:bigint,end:bigint,string:string,novelty:double>>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, out)

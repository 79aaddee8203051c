"""Operator 13: secrets in texts, by shapes and by a battery of randomness tests.

Three shapes are found as they are (assign, access, hex). Of the other long tokens a battery asks
whether they look drawn at random from the smallest alphabet that holds them (the inferred
encoding): chi-squared uniformity of symbols, Wald and Wolfowitz's runs above and below the middle
of the alphabet, and serial correlation of neighbours. The three p-values are combined by Cauchy's
rule, which holds for dependent tests.

Short tokens pass such tests by chance, the more often the smaller the alphabet. So ordinary text is
put to the same battery as decoys: every text without its tokens is cut into windows of the lengths
of all length bands. For each encoding and band the share of decoys that pass a level, over the
share of tokens that do, estimates the false discoveries among the latter; tokens are secrets
from the least level on at which that is at most `false_share`. Both are shares of all tokens and of all
text, so a level doesn't depend on how many there are.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, small_batches, whole

# The three shapes; the length of assign is that of its second group.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
#: What else may be a secret, and what it may consist of, smallest alphabet first.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
ENCODINGS = {
    "decimal": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "lower": LOWER, "upper": UPPER, "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_", "mixed": UPPER + LOWER + DIGITS + "+/-_",
}
NAMES = list(ENCODINGS)
#: Alphabets that differ in case alone are judged together.
ALIKE = {"HEX": "hex", "upper": "lower", "BASE36": "base36"}
CLASS = [NAMES.index(ALIKE.get(name, name)) for name in NAMES]
#: Least lengths of the bands.
BANDS = (16, 20, 24, 32, 40, 48, 64, 96, 128)
#: Levels of the combined p-value; below the first, randomness is refused.
LEVELS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
#: Symbols that are tested at once.
CHUNK = 1 << 19

_holds, _value, _size = np.zeros(256, np.uint16), np.zeros((len(NAMES), 256), np.uint8), np.array([len(a) for a in ENCODINGS.values()])
for _i, _alphabet in enumerate(ENCODINGS.values()):
    for _v, _c in enumerate(_alphabet):
        _holds[ord(_c)] |= 1 << _i
        _value[_i, ord(_c)] = _v
_erfc = np.vectorize(math.erfc, otypes=[float])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three shapes, by start, then kind."""
    found = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def battery(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ASCII codes of one length: each row's inferred encoding (its place in NAMES) and its combined p-value."""
    n, length = rows.shape
    bits = np.bitwise_and.reduce(_holds[rows], axis=1).astype(np.int64)
    encoding = np.log2(bits & -bits).astype(np.int64)
    v = _value[encoding[:, None], rows].astype(np.int64)
    k = _size[encoding].astype(float)
    counts = np.bincount((np.arange(n)[:, None] * 67 + v).ravel(), minlength=n * 67).reshape(n, 67)
    chi = k / length * (counts.astype(float) ** 2).sum(axis=1) - length
    free = k - 1
    uneven = ((np.maximum(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free))
    p_chi = _erfc(np.abs(uneven) / math.sqrt(2))  # too even is as suspect as too uneven
    high = 2 * v >= k[:, None]
    up = high.sum(axis=1).astype(float)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 2 * up * (length - up) / length + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (length - 1), 0))
    p_runs = np.where(spread > 0, _erfc(np.abs(runs - mean) / np.where(spread > 0, spread, 1) / math.sqrt(2)), 2.0 ** (1 - length))
    total, squares = v.sum(axis=1).astype(float), (v * v).sum(axis=1).astype(float)
    beside = (v * np.roll(v, -1, axis=1)).sum(axis=1).astype(float)
    varied = length * squares - total**2
    serial = (length * beside - total**2) / np.where(varied > 0, varied, 1)
    z = (serial + 1 / (length - 1)) * (length - 1) * math.sqrt(length - 2) / length
    p_serial = np.where(varied > 0, _erfc(np.abs(z) / math.sqrt(2)), 0.0)
    each = np.clip(np.stack([p_chi, p_runs, p_serial]), 1e-15, 0.99)  # a perfect fit in one test must not outweigh the others
    return encoding, 0.5 - np.arctan(np.tan((0.5 - each) * math.pi).mean(axis=0)) / math.pi


def tested(tokens: list[str]) -> list[tuple[int, int, int]]:
    """(encoding, band, level) of each token; level 0 is refused."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(tokens)
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, t in enumerate(tokens):
        by_length[len(t)].append(i)
    for length, ids in by_length.items():
        band = int(np.searchsorted(BANDS, length, side="right")) - 1
        step = max(1, CHUNK // length)
        for a in range(0, len(ids), step):
            part = ids[a : a + step]
            encoding, p = battery(np.frombuffer("".join(tokens[i] for i in part).encode("ascii"), np.uint8).reshape(len(part), length))
            for i, e, level in zip(part, encoding.tolist(), np.searchsorted(LEVELS, p, side="right").tolist(), strict=True):
                out[i] = (e, band, level)
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of the tokens that no base span touches."""
    out, i = [], 0
    ends: list[int] = []
    for _, b, _ in base:  # base spans by start, with the furthest end so far
        ends.append(max(b, ends[-1] if ends else 0))
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][0] < b:
            i += 1
        if i == 0 or ends[i - 1] <= a:
            out.append((a, b))
    return out


def windows(text: str, taken: Iterable[tuple[int, int]]) -> Iterator[str]:
    """Decoys: the text outside of what is taken as one string, cut into windows of the bands' lengths by turns; its words are joined as in names of one style or another."""
    pieces, at = [], 0
    for a, b in sorted(taken):
        if a > at:
            pieces.append(text[at:a])
        at = max(at, b)
    pieces.append(text[at:])
    rest = re.sub(r"[^A-Za-z0-9]+", ("", "_", "-", "/")[len(text) % 4], " ".join(pieces))
    at = turn = 0
    while at + BANDS[turn % len(BANDS)] <= len(rest):
        yield rest[at : at + BANDS[turn % len(BANDS)]]
        at += BANDS[turn % len(BANDS)]
        turn += 1


def scan_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row: _id, counts, base (spans as text), found (base and candidate spans, the latter with encoding, band and level), and in one row of each batch the decoys' counts."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("encoding", pa.int32()), ("band", pa.int32()), ("level", pa.int32())])
    tally = pa.struct([("encoding", pa.int32()), ("band", pa.int32()), ("level", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts: list[list[int]] = [[], [], []]
            base, found, tokens, owner = [], [], [], []
            decoys: Counter[tuple[int, int, int]] = Counter()
            held: list[str] = []
            size = 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                spans = base_spans(text)
                more = candidates(text, spans)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[2] == kind for s in spans))
                base.append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
                found.append([(a, b, k, None, None, None) for a, b, k in spans])
                tokens += [text[a:b] for a, b in more]
                owner += [(row, a, b) for a, b in more]
                for w in windows(text, [*more, *((a, b) for a, b, _ in spans)]):
                    held.append(w)
                    size += len(w)
                    if size > CHUNK * len(BANDS):
                        decoys.update(tested(held))
                        held, size = [], 0
            decoys.update(tested(held))
            for (row, a, b), judged in zip(owner, tested(tokens), strict=True):
                found[row].append((a, b, "random", *judged))
            first = [[(*k, n) for k, n in sorted(decoys.items())]] + [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array([[dict(zip(span.names, f, strict=True)) for f in r] for r in found], pa.list_(span)), pa.array([r and [dict(zip(tally.names, f, strict=True)) for f in r] for r in first], pa.list_(tally))],
                names=["_id", *(f"n_{k}" for k in KINDS), "base", "found", "decoys"],
            )

    three = "encoding: int, band: int, level: int"
    schema = f"_id {df.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base string, found array<struct<start: int, end: int, kind: string, {three}>>, decoys array<struct<{three}, n: long>>"
    return df.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).mapInArrow(run, schema)


def chosen_levels(targets: Counter, decoys: Counter, false_share: float) -> dict[tuple[int, int], int]:
    """(encoding, band) -> the least level from which on tokens are secrets; counts are by (encoding, band, level). Digits alone are numbers."""
    tokens, texts, hits, false = Counter(), Counter(), Counter(), Counter()
    for total, passed, counts in ((tokens, hits, targets), (texts, false, decoys)):
        for (encoding, band, level), n in counts.items():
            total[band] += n
            for reached in range(1, level + 1):
                passed[CLASS[encoding], band, reached] += n
    out = {}
    for encoding, band in {k[:2] for k in targets if k[0] != NAMES.index("decimal")}:
        kind = CLASS[encoding]
        good = [x for x in range(1, len(LEVELS) + 1) if hits[kind, band, x] and false[kind, band, x] * tokens[band] <= false_share * hits[kind, band, x] * texts[band]]
        if good:
            out[encoding, band] = good[0]
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = 0.05) -> DataFrame:
    """One row for each row of df: id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end by start, then kind: the three shapes, and tokens (kind `random`)
    that the battery takes for secrets; these never touch a base span. Null counts as empty: no
    spans. Texts of any length are read whole. Repeated rows each have their result; an empty table
    gives an empty table; other columns don't matter. What comes to the driver is at most a count
    for each encoding, band and level.
    """
    small_batches(df.sparkSession)
    scanned = durable(scan_secrets(df, id_col, text_col))
    three = ("encoding", "band", "level")

    def tallied(rows: DataFrame, n) -> Counter:
        return Counter({tuple(r[:3]): r[3] for r in rows.groupBy(*three).agg(n.alias("n")).collect()})

    targets = tallied(scanned.select(F.inline("found")).where("encoding IS NOT NULL"), F.count("*"))
    decoys = tallied(scanned.select(F.inline("decoys")), F.sum("n"))
    levels = chosen_levels(targets, decoys, false_share)
    least = F.lit(None).cast("int")
    never = len(LEVELS) + 1
    table = F.array(*(F.lit(levels.get((e, b), never)) for e in range(len(NAMES)) for b in range(len(BANDS))))
    kept = F.filter("found", lambda s: s["encoding"].isNull() | (s["level"] >= F.get(table, s["encoding"] * len(BANDS) + s["band"])))
    order = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "random"))), s["kind"]).alias("nth"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select(F.col("_id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2(F.col("base"), 256).alias("base_sha256"), spans.alias("spans"))

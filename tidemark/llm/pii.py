"""Operator 7: information-theoretic sanitisation of personal data.

Protected entities are what four patterns find (email, ip, card, phone). Over the whole corpus
it is then estimated how strongly a term that stands in a document with an entity reveals it: the
bits of doubt that are left about the entity for who knows the term, which is the entity's own
information less the pointwise mutual information of the two,
    log2(c(t) / c(e,t) * (k + 1) / k),
with document counts and k, the number of differently worded documents of the pair: a pair is
reckoned as if one more document had the term without the entity, so few documents leave more doubt than
many, and copies count as one. The doubt doesn't depend on the size of the corpus. Terms that leave no more
than the threshold are added as spans of kind `term` wherever they stand in the entity's documents, to be
generalised with it.

Entities that stand in the same documents are one class, and so are terms; what is counted
together are classes, so a document of many entities and many terms isn't their product.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, small_batches, whole

KINDS = ("email", "ip", "card", "phone")
# The characters and shapes of the four kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{4,}")
#: Terms that a task counts before it hands the counts on.
COUNTED = 200_000


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        run = text[done:at]
        start = done + len(run.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done, following = m.end(), text.find("@", m.end())
        else:
            done, following = at + 1, text.find("@", at + 1)
        at = following


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Within a run of dotted numbers the leftmost matches are its numbers by fours."""
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Entities by kind as listed, then start; offsets in code points, end exclusive."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(kind, *x) for kind, find in (("ip", ips), ("card", cards), ("phone", phones)) for x in find(text)]
    return found


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The terms outside of all entities, in their order."""
    covered = sorted((a, b) for _, a, b in spans)
    i = 0
    for m in TERM.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if i == len(covered) or covered[i][0] >= m.end():
            yield m.group().lower(), *m.span()


def scan_personal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row: _row, id, the four counts, base (spans as text); of rows with entities also these, their terms, a mark of the wording and the packed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base, entities, terms, marks, packed = [], [], [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                spans = base_spans(text)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                base.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                words = [t for t, _, _ in terms_outside(text, spans)] if spans else []
                entities.append(sorted({text[a:b] for _, a, b in spans}))
                terms.append(" ".join(dict.fromkeys(words)))
                marks.append(int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "big", signed=True))
                packed.append(zlib.compress(text.encode(), 1) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.string()), pa.array(marks, pa.int64()), pa.array(packed, pa.binary())],
                names=["_row", "_id", *(f"n_{k}" for k in KINDS), "base", "entities", "terms", "mark", "packed"],
            )

    schema = f"_row long, _id {df.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>, terms string, mark long, packed binary"
    texts = df.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    return texts.select(F.monotonically_increasing_id().alias("_row"), "_id", "_text").mapInArrow(run, schema)


def terms_of(text: str) -> set[str]:
    return {m.lower() for m in TERM.findall(text)}


def counted_terms(df: DataFrame, text_col: str) -> DataFrame:
    """(term, c_t): in how many rows each term stands, counted in the workers before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(terms_of(text.as_py()))
                if len(seen) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    return df.select(whole(text_col).alias("_text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("c_t"))


def _classes(stands: DataFrame, what: str) -> DataFrame:
    """(what, _class, rows) from (_row, what): those that stand in the same rows share a class, told by two sums of hashes and the number of rows."""
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "_row").cast("decimal(38,0)"))
    sums = stands.groupBy(what).agg(F.count("*").alias("rows"), wide(1).alias("_a"), wide(2).alias("_b"))
    return sums.select(what, F.sha2(F.concat_ws("#", "rows", "_a", "_b"), 256).alias("_class"), "rows")


def revealing_terms(scanned: DataFrame, df: DataFrame, text_col: str, doubt: float) -> DataFrame:
    """For each row that has some: _row and revealing, its revealing terms parted by spaces."""
    n = scanned.count()
    beside = scanned.select("_row", "mark", F.explode("entities").alias("entity"))
    known = _classes(beside, "entity").withColumnsRenamed({"_class": "entity_class", "rows": "c_e"}).where(F.col("c_e") < n)
    beside = durable(beside.join(known, "entity").select("_row", "mark", "entity_class", "c_e").distinct())
    most = beside.agg(F.max("c_e").alias("x")).first()["x"]
    if most is None:
        return scanned.select("_row", F.lit("").alias("revealing")).limit(0)
    # A term of more documents leaves more doubt about any entity, whatever the documents of the pair.
    reach = 2.0**doubt
    bounds = beside.groupBy("_row").agg(F.max("c_e").alias("most"))
    held = scanned.where(F.col("terms") != "").select("_row", F.explode(F.split("terms", " ")).alias("term"))
    rare = held.join(counted_terms(df, text_col), "term").where(F.col("c_t") <= reach * most)
    rare = durable(rare.join(bounds, "_row").where(F.col("c_t") <= reach * F.col("most")).drop("most"))
    alike = _classes(rare, "term").select("term", F.col("_class").alias("term_class"))
    rare = durable(rare.join(alike, "term").withColumn("term_class", F.concat_ws("#", "term_class", "c_t")))
    kinds = rare.select("_row", "term_class", "c_t").distinct()
    pairs = kinds.join(beside, "_row").groupBy("entity_class", "term_class").agg(F.count("*").alias("both"), F.count_distinct("mark").alias("wordings"), F.max("c_t").alias("c_t"))
    told = pairs.where(F.greatest("both", "c_t") * (F.col("wordings") + 1) <= reach * F.col("both") * F.col("wordings")).select("entity_class", "term_class")
    shown = kinds.select("_row", "term_class").join(beside.select("_row", "entity_class"), "_row").join(told, ["entity_class", "term_class"], "left_semi").select("_row", "term_class").distinct()
    found = rare.select("_row", "term", "term_class").join(shown, ["_row", "term_class"], "left_semi")
    return found.groupBy("_row").agg(F.array_join(F.collect_set("term"), " ").alias("revealing"))


def term_spans(packed, revealing):
    """Spans of the revealing terms in packed texts, as text; None where there are none."""
    import pandas as pd

    out = []
    for z, told in zip(packed, revealing, strict=True):
        spans = None
        if isinstance(told, str) and told:
            text, told = zlib.decompress(z).decode(), set(told.split(" "))
            spans = ",".join(f"term:{a}:{b}" for t, a, b in terms_outside(text, base_spans(text)) if t in told)
        out.append(spans)
    return pd.Series(out, dtype=object)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", doubt: float = 1.0) -> DataFrame:
    """One row for each row of df: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    spans lists kind:start:end of the entities and then of revealing terms (kind `term`), which
    never overlap entities. `doubt` is how many bits of doubt about an entity a term must at most leave;
    terms are judged and marked over the whole of an entity's documents, however
    long. In documents without the entity they stay: with the entity's own documents clean, they
    lead nowhere. Null counts as empty: no spans. Repeated rows each have their result; an empty
    table gives an empty table; other columns don't matter.
    """
    small_batches(df.sparkSession)
    scanned = durable(scan_personal(df, id_col, text_col))
    added = revealing_terms(scanned, df, text_col, doubt)
    return scanned.join(added, "_row", "left").withColumn("more", F.pandas_udf(term_spans, "string")("packed", "revealing")).select(
        F.col("_id").alias(id_col),
        *(f"n_{k}" for k in KINDS),
        F.sha2(F.col("base"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more").alias("spans"),
    )


def sanitised(text: str | None, spans: str) -> str | None:
    """The text with entities and revealing terms replaced by the names of their kinds."""
    if not text or not spans:
        return text
    parsed = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    out, at = [], 0
    for a, b, kind in parsed:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(df: DataFrame, text_col: str = "text", spans_col: str = "spans", out: str = "sanitised") -> DataFrame:
    """Adds `out`: the text without what the spans name. Null text stays null."""

    @F.pandas_udf("string")
    def replaced(texts, spans):
        import pandas as pd

        return pd.Series([sanitised(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return df.withColumn(out, replaced(F.col(text_col), F.coalesce(F.col(spans_col), F.lit(""))))

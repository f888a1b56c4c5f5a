"""Divergence audit: how far the word shares of sources lie apart, language by language.

1. ``bytes.translate`` lowers letters and blanks everything between terms in one pass, ``bytes.split``
   cuts, and a Counter per document gives frequencies; a task adds them up per group before it emits.
2. Terms are dealt out by (language, term), where all sources of a term meet: totals, document counts
   and what is kept come from that one shuffle.
3. Shares are whole numbers of a billionth, so that all sums are exact. What a source has of a term is
   compared with every other source of the language in tiles: a part of the terms by two blocks of
   sources. A tile returns sums, never terms, and terms that none of its sources has are counted
   once by their number.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.llm.store import Store, small_batches
from authloom.llm.words import parts, slices, text_bytes

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
HELD = 200_000      # terms that a task adds up before it emits them
BLOCK = 128         # sources of one side of a tile
PART_ROWS = 200_000  # counts of one tile, about
TERMS = 2048        # terms compared at a time
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DOC = 1 << 40      # one document, in a number that holds occurrences below


def _counted(batches):
    """``lang, source, term, n, docs``: occurrences and documents of terms, added up in the task."""
    held, size = defaultdict(dict), 0

    def batch():
        columns = [[], [], [], []]
        for (lang, source), terms in held.items():
            columns[0].append(pa.repeat(pa.scalar(lang, pa.string()), len(terms)))
            columns[1].append(pa.repeat(pa.scalar(source, pa.string()), len(terms)))
            columns[2].append(pa.array(list(terms), pa.binary()))
            columns[3].append(np.fromiter(terms.values(), dtype=np.int64, count=len(terms)))
        value = np.concatenate(columns[3]) if columns[3] else np.zeros(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [*[pa.concat_arrays(c) if c else pa.array([], t) for c, t in
               zip(columns[:3], (pa.string(), pa.string(), pa.binary()), strict=True)],
             pa.array(value & (_DOC - 1)), pa.array(value >> 40)], ["lang", "source", "term", "n", "docs"])

    for rows in batches:
        lang, source = (rows.column(k).to_pylist() for k in (0, 1))
        data, offsets = text_bytes(rows.column(2))
        for lo, hi in slices(offsets):
            for k in range(lo, hi):
                terms = held[lang[k], source[k]]
                get, before = terms.get, len(terms)
                counter: Counter[bytes] = Counter()
                for part in parts(data[offsets[k]:offsets[k + 1]].tobytes().translate(_LOWER)):
                    counter.update(part.split())
                for term, n in counter.items():
                    terms[term] = get(term, 0) + n + _DOC
                size += len(terms) - before
            if size > HELD:
                yield batch()
                held.clear()
                size = 0
    yield batch()


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(billion * (count + 1) / (total + terms)), exact for any count."""
    big = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (big(count) + 1), big(total) + big(terms))
    return F.when(big(total) + big(terms) > 0, whole + 1)


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n, first``: the terms that at least ``least_docs`` documents of a language have.

    One row per group that has the term, ``n`` its occurrences there, ``lang_n`` those in the language;
    ``first`` marks one row of each term of a language.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    # adding up what one flush of a task has twice is no use before the shuffle
    summed = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    everywhere = Window.partitionBy("lang", "term")
    return (summed.withColumns({"all": F.sum("docs").over(everywhere), "lang_n": F.sum("n").over(everywhere),
                                "first": F.col("source") == F.min("source").over(everywhere)})
            .where(F.col("all") >= least_docs)
            .select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "first"))


def groups_of(docs: DataFrame, counts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, total, lang_total, terms, rows``: every group, even without terms, with its sums."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    every = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    own = counts.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"), F.count_if("first").alias("terms"))
    langs = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("terms"), F.sum("rows").alias("rows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (every.join(own.select("lang", "source", "total"), ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", zero("total"), zero("lang_total"), zero("terms"), zero("rows")))


def _tile(table: pa.Table) -> pa.Table:
    """Sums of one tile: ``lang, source, item, value, seen``.

    Rows without term name the sources of both sides with their share of what they don't have.
    """
    lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
    heads = table.filter(pc.is_null(table.column("term")))
    names, base = heads.column("source").combine_chunks(), np.asarray(heads.column("p"))
    block = np.asarray(heads.column("block"))
    rows = table.filter(pc.is_valid(table.column("term")))
    at = np.asarray(pc.index_in(rows.column("source"), names)).astype(np.int64)
    term = rows.column("term").combine_chunks().dictionary_encode()
    if isinstance(term, pa.ChunkedArray):
        term = term.combine_chunks()
    code, n = np.asarray(term.indices).astype(np.int64), len(term.dictionary)
    order = np.argsort(code, kind="stable")
    code, at, share_of = code[order], at[order], np.asarray(rows.column("p"))[order]
    out = np.zeros((len(names), len(names)), dtype=np.int64)
    left = np.flatnonzero(block == i)
    right = np.flatnonzero(block == j)
    for lo in range(0, n, TERMS):
        a, b = np.searchsorted(code, (lo, lo + TERMS))
        dense = np.repeat(base[:, None], min(TERMS, n - lo), axis=1)
        dense[at[a:b], code[a:b] - lo] = share_of[a:b]
        for k in left:
            for some, one in ((right, True),) if i == j else ((right, True), (right, False)):
                p, q = (dense[k][None, :], dense[some]) if one else (dense[some], dense[k][None, :])
                value = ((p - q) * (p - q) // q).sum(axis=1)
                if one:
                    out[k, some] += value
                else:
                    out[some, k] += value
    x, y = np.meshgrid(left, right, indexing="ij")
    x, y = x.ravel(), y.ravel()
    if i != j:
        x, y = np.concatenate((x, y)), np.concatenate((y, x))
    x, y = x[x != y], y[x != y]
    return pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(x)), "source": names.take(pa.array(x)),
                     "item": names.take(pa.array(y)), "value": pa.array(out[x, y]),
                     "seen": pa.repeat(pa.scalar(n, pa.int64()), len(x))})


def pair_sums(counts: DataFrame, groups: DataFrame, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """``lang, source, item, value``: for every two sources of a language their difference over all kept terms."""
    sides = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = groups.join(sides, "lang").select(
        "lang", "source", "total", "terms", "blocks", F.expr("pmod(xxhash64(source), blocks)").cast("int").alias("block"),
        F.ceil(F.col("rows") / part_rows).cast("int").alias("parts"), share(F.lit(0), "total", "terms").alias("p0"))
    shared = ["lang", "source", "block", "blocks"]
    heads = placed.where("parts > 0").select(
        *shared, F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(None).cast("string").alias("term"),
        F.col("p0").alias("p"))
    cells = counts.join(placed, ["lang", "source"]).select(
        *shared, F.expr("pmod(xxhash64(term), parts)").cast("int").alias("part"), "term",
        share("n", "total", "terms").alias("p"))
    tiled = heads.unionByName(cells).select(
        "lang", "source", "block", "part", "term", "p", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    tiled = tiled.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         "part", "source", "block", "term", "p")
    sums = tiled.groupBy("lang", "i", "j", "part").applyInArrow(
        _tile, "lang string, source string, item string, value long, seen long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    x = placed.select("lang", "source", "terms", F.col("p0").alias("p"))
    y = placed.select("lang", F.col("source").alias("item"), F.col("p0").alias("q"))
    rest = F.col("terms") - F.coalesce("seen", F.lit(0))
    value = F.coalesce("value", F.lit(0)) + F.when(rest > 0, rest * apart("p", "q")).otherwise(0)
    return x.join(y, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", "item", value.cast("long").alias("value"))


def term_gains(counts: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: the terms a source has more of than its language, the ``top`` first."""
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share("n", "total", "terms").alias("p"),
        share("lang_n", "lang_total", "terms").alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (shares.select("lang", "source", "item", apart("p", "q").alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


@small_batches(1000)
def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: every source against the others and against its language.

    ``part`` is ``pair`` (item: another source) or ``term`` (item: a term, ``top`` at most). Null text,
    language and source are ''. A language without kept terms has pairs of value 0, a group without
    terms only pairs. Repeated rows are documents of their own; other columns are ignored; an empty
    table gives an empty result. Ties rank by item.
    """
    store = Store(docs.sparkSession, "divergence")
    counts = store.save(term_counts(docs, text_col, lang_col, source_col, least_docs), "counts")
    groups = store.save(groups_of(docs, counts, lang_col, source_col), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(counts, groups).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(term_gains(counts, groups, top).withColumn("part", F.lit("term")).select(*columns)))

"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base expressions find e-mail addresses, IP addresses, card and phone numbers. They are the seeds. A slot
between two words makes two lexical patterns of its kind: the word before it, which is the token before
or the start of its own token if it is glued to a label ('tel:' in 'tel:+1...'), and the word after it,
the next whole token. Patterns and instances form a graph whose scores are computed in rounds, until they
settle. A pattern's score is the share of its occurrences in the corpus (of all occurrences of the word,
wherever it stands: as a token, as the start of one up to a sign, or up to a span) that stand beside an
instance, weighed by the instances' scores, and counts only if enough different instances back it. An
instance that the base expressions left (a number that fails its check, an address that is written out)
gets the score of its best pattern. Instances of high score back further patterns in the next round. Base
spans always stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.llm.store import Store

# The base expressions. Possessive and anchored forms of the plain ones: they match the
# same spans, in linear time and without recursion on long runs. \G is the end of the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

# Shapes of what the base expressions don't cover: candidates, taken only on the word of a pattern.
AT, DOT = r"\x20?(?:\(at\)|\[at\])\x20?", r"\x20?(?:\(dot\)|\[dot\]|\.)\x20?"
WRITTEN_EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

WINDOW = 64       # last characters of a token that make a word
SUPPORT = 3       # different instances that a pattern needs
CONFIDENCE = 0.5  # least score of a pattern whose instances are taken
SETTLED = 1e-3    # change of a pattern's score that asks for another round

_BLANK = _BLANK_SET = r"' \t\n\u000B\f\r'"  # what \s matches
_WHITE = r"r'\s+'"
_PLAIN, _SIGN = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
_SPAN = "struct<start:bigint,end:bigint,value:string>"


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _unit(text: str) -> str:
    """SQL: a word as patterns have it."""
    return f"lower(regexp_replace({text}, '[0-9]', '0'))"


def _spans(pattern: str, guard: str) -> str:
    """SQL: start, end and text of every match, in characters; ``guard`` is a cheap necessary condition."""
    p = _literal(pattern)
    return f"""CASE WHEN {guard} THEN aggregate(
        arrays_zip(transform(split(t, {p}, -1), x -> char_length(x)), regexp_extract_all(t, {p}, 0)),
        named_struct('at', 0L, 'out', cast(array() AS array<{_SPAN}>)),
        (s, x) -> named_struct(
            'at', s.at + x['0'] + coalesce(char_length(x['1']), 0),
            'out', CASE WHEN x['1'] IS NULL THEN s.out ELSE concat(s.out, array(named_struct(
                'start', s.at + x['0'], 'end', s.at + x['0'] + char_length(x['1']), 'value', x['1']))) END),
        s -> s.out) ELSE cast(array() AS array<{_SPAN}>) END"""


_DIGITS = "regexp_replace(m.value, '[^0-9]', '')"
# (kind, expression, guard, check of a match)
_BASE = [
    ("email", EMAIL, "contains(t, '@')", "true"),
    ("ip", IP, "t RLIKE '[0-9][.][0-9]'",
     "forall(split(m.value, '[.]'), p -> char_length(ltrim('0', p)) <= 3 AND coalesce(try_cast(p AS bigint), 0) <= 255)"),
    ("card", CARD, "t RLIKE '[0-9][ -]?[0-9]'",
     f"char_length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS})"),
    ("phone", PHONE, "contains(t, '+')", f"char_length({_DIGITS}) BETWEEN 9 AND 15"),
]
# candidates among failed matches are those of a plausible length
_FAILED = {"ip": "true", "card": f"char_length({_DIGITS}) BETWEEN 12 AND 19", "phone": f"char_length({_DIGITS}) BETWEEN 7 AND 15"}
_LOOSE = [
    ("email", WRITTEN_EMAIL, "t RLIKE '[(\\\\[]at[)\\\\]]'"),
    ("phone", LOCAL_PHONE, "t RLIKE '[0-9]{3}[ .-][0-9]{4}'"),
]


def find_spans(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``id, text_key, base, loose`` per row: base spans, and candidates with the word before each span."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for kind, pattern, guard, _ in _BASE:
        rows = rows.withColumn(f"m_{kind}", F.expr(_spans(pattern, guard)))
    for kind, pattern, guard in _LOOSE:
        rows = rows.withColumn(f"l_{kind}", F.expr(_spans(pattern, guard)))
    tagged = lambda kind, source, check: F.expr(
        f"transform(filter({source}, m -> {check}), m -> named_struct('kind', '{kind}', 'start', m.start, 'end', m.end, 'value', m.value))")
    rows = rows.withColumn("base", F.concat(*[tagged(k, f"m_{k}", check) for k, _, _, check in _BASE]))
    rows = rows.withColumn("loose", F.concat(
        *[tagged(k, f"m_{k}", f"NOT ({check}) AND {_FAILED[k]}") for k, _, _, check in _BASE if k in _FAILED],
        *[tagged(k, f"l_{k}", "true") for k, _, _ in _LOOSE]))
    # a candidate that touches a base span is a part of it
    rows = rows.withColumn("loose", F.expr(
        "filter(loose, c -> NOT exists(base, b -> b.start < c.end AND c.start < b.end))"))
    trimmed = lambda x: f"trim(TRAILING {_BLANK} FROM {x})"
    near = trimmed(f"substring(t, cast(greatest(m.start - {WINDOW} + 1, 1) AS int), cast(least(m.start, {WINDOW}) AS int))")
    # more than the window is looked at only where blanks push the word out of it
    head = (f"CASE WHEN m.start > {WINDOW} AND char_length({near}) < {WINDOW} AND NOT {near} RLIKE r'\\s' "
            f"THEN {trimmed('substring(t, 1, cast(m.start AS int))')} ELSE {near} END")
    last = f"element_at(split(right({head}, {WINDOW}), r'\\s+'), -1)"
    before = f"nullif({_unit(last)}, '')"
    glued = f"substring(t, cast(m.start AS int), 1) RLIKE {_literal(_PLAIN)} AND m.start > 0"
    # the next whole token, if a blank ends the span; more than the window is looked at only where it is cut there
    rest = lambda n: f"ltrim({_BLANK_SET}, substring(t, cast(m.end AS int) + 1, {n}))"
    tail = f"CASE WHEN {rest(WINDOW)} RLIKE r'\\s' THEN {rest(WINDOW)} ELSE {rest('char_length(t)')} END"
    after = f"nullif({_unit(f'left(element_at(split({tail}, {_WHITE}, 2), 1), {WINDOW})')}, '')"
    after = f"CASE WHEN substring(t, cast(m.end AS int) + 1, 1) RLIKE r'\\s' THEN {after} END"
    for c in ("base", "loose"):
        rows = rows.withColumn(c, F.expr(
            f"transform({c}, m -> named_struct('kind', m.kind, 'start', m.start, 'end', m.end, "
            f"'value', lower(m.value), 'word', {before}, 'glued', {glued}, 'after', {after}))"))
    return rows.select("id", F.md5("t").alias("text_key"), "base", "loose")


def word_counts(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """How often each pattern word occurs in all texts, wherever: as a token, as a token's start up to
    each of its signs, and as a token's start that ends inside letters where a span begins."""
    tokens = (docs.select(F.explode(F.split(F.col(text_col).cast("string"), r"\s+")).alias("token")).where("token <> ''")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    # a piece has one character at least, so that the last pieces cover the last characters
    pieces = F.expr(f"filter(split(token, {_literal(f'(?<={_SIGN})')}), p -> p <> '')")
    starts = F.expr(f"transform(p, (x, k) -> right(array_join(slice(p, greatest(k + 2 - {WINDOW}, 1), least(k + 1, {WINDOW})), ''), {WINDOW}))")
    words = tokens.select("n", pieces.alias("p")).select("n", F.explode(starts).alias("word")).select(
        F.expr(_unit("word")).alias("word"), "n")
    inside = found.select(F.explode(F.expr(
        "array_distinct(transform(filter(concat(base, loose), m -> m.glued), m -> named_struct('word', m.word, 'start', m.start)))")).alias("m"))
    return words.unionByName(inside.select("m.word", F.lit(1).cast("long").alias("n"))).groupBy("word").agg(F.sum("n").alias("times"))


def discover(found: DataFrame, docs: DataFrame, text_col: str, store: Store) -> DataFrame:
    """``text_key, extra``: the candidates that stand beside patterns of high score."""
    every = (found.select("text_key", F.explode("base").alias("m"), F.lit(True).alias("seed"))
             .unionByName(found.select("text_key", F.explode("loose").alias("m"), F.lit(False).alias("seed"))))
    sides = F.expr("array(named_struct('side', 'before', 'word', m.word), named_struct('side', 'after', 'word', m.after))")
    seen = store.save(every.select("text_key", "m.kind", "m.start", "m.end", "m.value", "seed", F.inline(sides))
                      .where("word IS NOT NULL"), "seen")
    pattern = ["kind", "side", "word"]
    # words beside fewer different instances than a pattern needs can be left out of the count
    able = seen.select(*pattern, "value").distinct().groupBy(*pattern).agg(
        F.count(F.lit(1)).alias("n")).where(f"n >= {SUPPORT}").select(*pattern)
    able = store.save(able.join(word_counts(docs, found, text_col), "word"), "able")
    # edges of the graph: a pattern, an instance, how often they met (copies of one text count each)
    edges = store.save(seen.join(able, pattern).groupBy(*pattern, "value", "times").agg(
        F.count(F.lit(1)).alias("met"), F.max(F.col("seed").cast("double")).alias("score")), "edges")
    scores = edges.groupBy("kind", "value").agg(F.max("score").alias("s"))
    patterns, k = None, 0
    while True:
        now = (edges.join(scores, ["kind", "value"]).groupBy(*pattern)
               .agg((F.sum(F.col("met") * F.col("s")) / F.max("times")).alias("p"),
                    F.count(F.when(F.col("s") >= CONFIDENCE, 1)).alias("backing")))
        now = now.withColumn("p", F.when(F.col("backing") >= SUPPORT, F.least("p", F.lit(1.0))).otherwise(0.0))
        now = store.save(now.select(*pattern, "p"), f"patterns-{k}")
        # scores only rise, so they settle
        moved = now if patterns is None else now.join(patterns.withColumnRenamed("p", "old"), pattern).where(F.col("p") > F.col("old") + SETTLED)
        patterns, k = now, k + 1
        if moved.isEmpty():
            break
        scores = store.save(edges.join(patterns, pattern).groupBy("kind", "value").agg(
            F.greatest(F.max("score"), F.max("p")).alias("s")), f"scores-{k}")
    sure = patterns.where(F.col("p") >= CONFIDENCE).select(*pattern)
    return (seen.where("NOT seed").join(sure, pattern).select("text_key", "kind", "start", "end").distinct()
            .groupBy("text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, ``n_email, n_ip, n_card, n_phone`` (all spans), ``base_sha256, spans``.

    Spans are kind:start:end in characters, end exclusive, by kind and start. Null texts count as
    empty. Null and repeated ids are carried along; other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    store = Store(docs.sparkSession, "pii")
    found = store.save(find_spans(docs, text_col, id_col), "found")
    extra = discover(found, docs, text_col, store)
    rows = found.join(extra, "text_key", "left")
    order = "array_position(array({}), m.kind)".format(", ".join(f"'{k}'" for k in KINDS))
    ranked = lambda source: (
        f"array_sort(transform({source}, m -> named_struct('rank', {order}, 'start', m.start, 'end', m.end, 'kind', m.kind)))")
    text = lambda source: F.expr(
        f"array_join(transform({source}, m -> concat_ws(':', m.kind, m.start, m.end)), ',')")
    rows = rows.withColumn("b", F.expr(ranked("base"))).withColumn(
        "s", F.expr("array_sort(array_union(b, {}))".format(ranked("coalesce(extra, array())"))))
    return rows.select(
        F.col("id").alias(id_col),
        *[F.expr(f"cast(size(filter(s, m -> m.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS],
        F.sha2(text("b"), 256).alias("base_sha256"), text("s").alias("spans"))

"""Personal data by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) are found by patterns that scan a text in linear time; offsets come
from the pieces between matches. Secrets, runs of 32 or more letters and digits mixed, are seeds as well. The seeds
induce lexical patterns: the word left of them, the last two or three words, the word right of them, and both
neighbours. Patterns and the instances seen in them (seeds, and other tokens with digits or an at sign) form a graph
that is scored in rounds: a pattern is as good as the instances it holds, an instance as good as its patterns.
Rounds end when no pattern is gained or lost. Tokens that are no seeds but stand in high-confidence patterns
are reported under the pattern's kind beside the seeds. Everything is DataFrame and SQL functions.

A seed's neighbours are those of the tokens it begins and ends in, so seeds and other tokens see a context alike:
whole words, up to the next token that holds a digit or an at sign. What lies within a text is matched by
sorting its few tokens and seeds, never by comparing all of them. Null and empty texts have no spans. Repeated rows
each give a row; an empty table gives none. Only doc_id and text are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import if_few, materialize, settled, texts

#: Kinds in the order of the results. Fixed values.
KINDS = ("email", "ip", "card", "phone")
#: All seeds: found like the base, but not part of it.
SEEDS = (*KINDS, "secret")
#: The same matches as the plain patterns (leftmost, not overlapping), but starting only where a run of
#: the first class starts or the match before ended, and without giving back, so that long runs stay linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+",
}
#: Tokens that may be identifiers.
TOKEN = r"(?<![^\s])(?=[^\s0-9@]*+[0-9@])\S++"
def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches located in one go; their arrays grow by copying, so long lists are built of short ones.
RUN = 256


def located(pattern: str, gate: str, context: bool = False) -> Column:
    """Matches as an array of (s, e, t): offsets and text; with context also l, up to three words before, and r, the word after."""
    p = quoted(pattern)
    item = "struct<s: int, e: int, t: string, l: string, r: string>" if context else "struct<s: int, e: int, t: string>"
    flat = "translate({0}, '\\t\\n\\r\\f', '    ')"
    more = f", lower(substring_index(rtrim({flat.format('x.b')}), ' ', -3)) as l, lower(substring_index(ltrim({flat.format('x.n')}), ' ', 1)) as r" if context else ""
    one = f"struct(a.p + length(x.b) as s, a.p + length(x.b) + length(x.m) as e, x.m as t{more})"
    return F.expr(f"""
      case when {gate} then
        aggregate(
          transform(
            transform(array(split(text, {p}, -1)), cut ->
              zip_with(zip_with(regexp_extract_all(text, {p}, 0), cut, (m, b) -> struct(m, b)), slice(cut, 2, size(cut)), (y, n) -> struct(y.m as m, y.b as b, n as n))),
            z -> transform(sequence(0, (size(z) - 1) div {RUN}), k -> slice(z, cast(k * {RUN} + 1 as int), {RUN})))[0],
          cast(struct(0 as p, array() as o) as struct<p: int, o: array<array<{item}>>>),
          (c, run) -> transform(
            array(aggregate(run, cast(struct(c.p as p, array() as o) as struct<p: int, o: array<{item}>>),
              (a, x) -> case when x.m is null then a else struct(a.p + length(x.b) + length(x.m) as p, concat(a.o, array({one})) as o) end)),
            i -> struct(i.p as p, concat(c.o, array(i.o)) as o))[0],
          c -> flatten(c.o))
      else cast(array() as array<{item}>) end""")


#: Which matches count.
VALID = {
    "email": "true",
    "ip": r"forall(split(x.t, '\\.'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', left(ltrim('0', p), 3)) as int) <= 255)",
    "card": """length(regexp_replace(x.t, '[ -]', '')) between 16 and 19 and
      aggregate(sequence(1, length(left(regexp_replace(x.t, '[ -]', ''), 19))), 0, (a, i) -> a +
        cast(substring(reverse(left(regexp_replace(x.t, '[ -]', ''), 19)), i, 1) as int) * (2 - i % 2) -
        case when i % 2 = 0 and cast(substring(reverse(left(regexp_replace(x.t, '[ -]', ''), 19)), i, 1) as int) > 4 then 9 else 0 end) % 10 = 0""",
    "phone": "length(regexp_replace(x.t, '[^0-9]', '')) between 8 and 15",
    "secret": "length(regexp_replace(x.t, '[^0-9]', '')) >= 8 and length(regexp_replace(x.t, '[^A-Za-z]', '')) >= 4",
}


def seeds_and_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of the row), an array for each kind of seeds, and all tokens."""
    gates = {"email": "instr(text, '@') > 0", "phone": "instr(text, '+') > 0", "secret": f"text rlike '[0-9]' and text rlike {quoted(BASE['secret'])}"}
    rows = texts(docs).withColumns({f"raw_{k}": located(p, gates.get(k, f"text rlike {quoted(p)}")) for k, p in BASE.items()} | {"token": located(TOKEN, "text rlike '[0-9@]'", context=True)})
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "token", *(F.expr(f"filter(raw_{k}, x -> {VALID[k]})").alias(k) for k in SEEDS))


def occurrences(found: DataFrame) -> DataFrame:
    """(row, kind, s, e, t, l, r): seeds, with the context of the tokens they begin and end in, and tokens (kind null) outside them."""
    token = found.select("row", F.explode("token").alias("x")).select("row", F.lit(None).cast("string").alias("kind"), "x.s", "x.e", "x.t", "x.l", "x.r", F.col("x.s").alias("place"), F.lit(0).alias("side"))
    seed = None
    for k in SEEDS:
        own = found.select("row", F.explode(k).alias("x")).select("row", F.lit(k).alias("kind"), "x.s", "x.e", "x.t")
        seed = own if seed is None else seed.unionAll(own)
    none = F.lit(None).cast("string")
    begins = seed.select("*", none.alias("l"), none.alias("r"), F.col("s").alias("place"), F.lit(1).alias("side"))
    ends = seed.select("*", none.alias("l"), none.alias("r"), (F.col("e") - 1).alias("place"), F.lit(2).alias("side"))
    line = Window.partitionBy("row").orderBy("place", "side")
    before, after = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    every = token.unionAll(begins).unionAll(ends).select(
        "*",
        F.last("l", True).over(before).alias("left"),
        F.last("r", True).over(before).alias("right"),
        F.max(F.expr("case when side = 1 then e end")).over(before).alias("covered"),
        F.min(F.expr("case when side > 0 then s end")).over(after).alias("next"),
    )
    bare = every.where("side = 0 and coalesce(covered <= s, true) and coalesce(next >= e, true)").select("row", "kind", "s", "e", "t", "l", "r")
    of_begin = every.where("side = 1").select("row", "kind", "s", "e", "t", F.col("left").alias("l"))
    of_end = every.where("side = 2").select("row", "kind", "s", "e", F.col("right").alias("r"))
    return bare.unionByName(of_begin.join(of_end, ["row", "kind", "s", "e"]).select(bare.columns))


#: Patterns of one occurrence, by what they look at.
FORMS = {
    "left": "substring_index(l, ' ', -1)",
    "left two": "case when instr(l, ' ') > 0 then substring_index(l, ' ', -2) end",
    "left three": "case when l like '% % %' then l end",
    "right": "r",
    "both": "case when l <> '' and r <> '' then concat(substring_index(l, ' ', -1), ' _ ', r) end",
}


def patterned(seen: DataFrame) -> DataFrame:
    """A row for each occurrence and each of its patterns."""
    each = F.explode(F.array(*(F.struct(F.lit(form).alias("form"), F.expr(how).alias("words")) for form, how in FORMS.items()))).alias("x")
    return seen.select("*", each).select(*seen.columns, "x.form", "x.words").where("words <> ''")


def confident(seen: DataFrame, rounds: int, least: float, support: int) -> DataFrame:
    """High-confidence patterns (form, words, kind) of the graph between patterns and instances.

    seen: (kind or null, t, form, words), a row for each occurrence and pattern.
    """
    # A seed has score 1 for its kind in round one. Pattern: mean score of its instances, with one doubtful
    # instance added; instance: the chance that not all its patterns are wrong.
    key = ["form", "words"]
    edges = materialize(seen.groupBy(*key, "t").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind is not null").select("t", "kind", F.lit(1.0).alias("score")).distinct()
    size = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    scored, last = seeds, None
    for _ in range(rounds):
        held = edges.drop("kind").join(scored, "t").groupBy(*key, "kind").agg(F.sum("score").alias("held"), F.sum(F.expr("cast(score >= 1 as int)")).alias("support"))
        held = held.where(F.col("support") >= support).join(size, key).select(*key, "kind", (F.col("held") / (F.col("size") + 1)).alias("score"))
        patterns = materialize(held, "patterns")
        good = patterns.where(F.col("score") >= least)
        mark = tuple(good.agg(F.count(F.lit(1)), F.sum(F.hash(*key, "kind").cast("long"))).first())
        if mark == last or not mark[0]:
            break
        last = mark
        other = edges.where("kind is null").select(*key, "t").join(patterns, key)
        scored = seeds.unionByName(other.groupBy("t", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("score")))))).alias("score")))
    return good.groupBy(*key).agg(F.max(F.struct("score", "kind")).alias("x")).select(*key, "x.score", "x.kind")


def find(docs: DataFrame, rounds: int = 10, least: float = 0.8, support: int = 5) -> DataFrame:
    """Per row: doc_id, row, base, secrets and all: arrays of (k: kind's rank, s, e) in order."""
    found = materialize(seeds_and_tokens(docs), "spans")
    seen = materialize(patterned(occurrences(found)), "seen")
    patterns = confident(seen.select("kind", "t", "form", "words"), rounds, least, support)
    new = seen.where("kind is null").drop("kind").join(patterns, ["form", "words"]).groupBy("row", "s", "e").agg(F.max(F.struct("score", "kind")).getField("kind").alias("kind"))
    rank = F.expr(f"array_position(array({', '.join(map(repr, SEEDS))}), kind)").cast("int")
    new = new.groupBy("row").agg(F.collect_list(F.struct(rank.alias("k"), "s", "e")).alias("new"))  # tokens of one text
    ranked = [F.expr(f"transform({k}, x -> struct({i + 1} as k, x.s as s, x.e as e))") for i, k in enumerate(SEEDS)]
    rows = found.select("doc_id", "row", F.concat(*ranked[: len(KINDS)]).alias("base"), ranked[-1].alias("secrets")).join(new, "row", "left")
    return rows.select("doc_id", "row", "base", "secrets", F.expr("array_sort(concat(base, secrets, coalesce(new, cast(array() as array<struct<k: int, s: int, e: int>>))))").alias("all"))


#: The kinds as an SQL array, and a span's kind.
NAMES = f"array({', '.join(map(repr, SEEDS))})"


def spelled(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at({NAMES}, x.k), x.s, x.e)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_secret, n_spans (all)."""
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i + 1})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    more = [F.size("secrets").cast("long").alias("n_secret"), F.size("all").cast("long").alias("n_spans")]
    return find(docs).select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("all").alias("spans"), *more)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; rows that repeat a doc_id are told apart by their text."""

    def told() -> DataFrame:
        spans = find(docs.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest")))).where("size(all) > 0")
        return spans.groupBy("doc_id").agg(F.first("all").alias("pii_all")).select(F.col("doc_id.id").alias("pii_id"), F.col("doc_id.digest").alias("pii_digest"), "pii_all")

    spans = if_few(settled(told, "redact"))
    own = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("pii_id")) & (own == F.col("pii_digest")), "left")
    # Spans by start; one that begins inside the one before is part of it.
    text = F.expr(f"""
      case when pii_all is null then text else
        aggregate(array_sort(transform(pii_all, x -> struct(x.s as s, -x.e as e, x.k as k))), struct(0 as p, '' as o),
          (a, x) -> case when x.s < a.p then a else struct(-x.e as p, concat(a.o, substring(text, a.p + 1, x.s - a.p), '[', upper(element_at({NAMES}, x.k)), ']') as o) end,
          a -> concat(a.o, substring(text, a.p + 1))) end""")
    return rows.withColumn("text", text).select(docs.columns)

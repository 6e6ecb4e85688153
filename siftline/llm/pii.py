r"""Personal data: rule-made seeds and bootstrapped contextual extraction.

Base spans come from four rules (email, ip, card, phone), leftmost and not
overlapping within a kind.  One pass cuts every text, for each rule, into pieces
"what lies before, what matches"; running sums of their lengths give positions.
Patterns use possessive repeats only, so time is linear in the text.

Base spans are seeds, and so are long tokens that mix letters and digits (of the kind
``secret``, which has no rule of its own).  The last word with a letter before a seed,
with the punctuation that stands between (``token =``), is a lexical pattern; tokens with a
digit or an at sign are instances.  Pattern and instance scores are computed in
turn on the table of (pattern, instance) counts: a pattern scores, by kind, the
share of all its occurrences in the corpus, whatever follows, that lead to
instances believed so far; an instance that is no seed is believed as far as its
patterns are (noisy or).  After some rounds, tokens behind patterns of high
confidence and enough support are added as spans of the pattern's kind (so a long
token alone, behind a word like any other, is not).  Base spans stay; a
match that a rule has rejected by its check digits or ranges isn't added.

DataFrame functions only.  Word counts, graph and scores cover the whole corpus.

Edge cases: a null text counts as empty; rows are told apart by a row number, so
repeated rows and null ids each get a result; positions are code points, ends
exclusive; a word and its punctuation of more than 64 characters are no pattern; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

KINDS = ("email", "ip", "card", "phone")
#: The kind that only contexts can find, and the shape of its seeds.
SECRET = "secret"
_SECRET_SHAPE = r"^(?=[^0-9]*+[0-9])(?=[^a-z]*+[a-z])[0-9a-z_+/=-]{24,}+$"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Per kind: group 1 lies before, group 2 matches or is skipped as a whole; the end of the text ends the last piece.
PIECES = {
    "email": rf"(?s)(.*?)((?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++|\z)",
    "ip": r"([^0-9]*+)([0-9]++(?:\.[0-9]++){3}|[0-9]++|\z)",
    "card": r"([^0-9]*+)([0-9]++(?:[\x20-][0-9]++)*+|\z)",
    "phone": r"([^+]*+)(\+[0-9][\x20().0-9-]+[0-9]|\+|\z)",
    "token": r"(?s)(.*?)((?<!\S)[^\s0-9@]*+[0-9@]\S*+|\z)",
}
#: Texts in which a kind can occur at all.
_POSSIBLE = {"email": "contains(text, '@')", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9]'", "phone": "contains(text, '+')", "token": "text rlike '[0-9@]'"}
_CONTEXT = 64
_TRIM_LEFT, _TRIM_RIGHT = r"""^["'(<\[{]+""", r"""["')>\]},.;:!?#$%&*]+$"""
#: A word with a letter, and the punctuation behind it.
_PATTERN = r"(?<!\S)[^\s\p{L}]*+\p{L}\S*+(?:\s++[^\s\p{L}\p{N}@]++(?!\S))?+"
_CANDIDATE = 5


def _pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, kind, pos, before, context, match``: all pieces of all texts; a row without any has null kind."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(kind: str):
        pattern = F.lit(PIECES[kind])
        piece = lambda m, p: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("before"), F.right(p, F.lit(_CONTEXT)).alias("context"), m.alias("match"))
        found = F.zip_with(F.regexp_extract_all("text", pattern, F.lit(2)), F.regexp_extract_all("text", pattern, F.lit(1)), piece)
        return F.when(F.expr(_POSSIBLE[kind]), found)

    none = F.expr("slice(array(struct('' as kind, 0 as before, '' as context, '' as match)), 1, 0)")
    every = F.concat(*(F.coalesce(cut(k), none) for k in PIECES))
    flat = rows.select("row", "doc_id", F.posexplode_outer(every).alias("pos", "x"))
    return flat.select("row", "doc_id", F.col("x.kind").alias("kind"), "pos", F.col("x.before").alias("before"), F.col("x.context").alias("context"), F.col("x.match").alias("match"))


def _luhn(digits):
    """The check digit of a digit string holds."""
    value = lambda x, i: F.when((F.length(digits) - i) % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))
    each = F.transform(F.split(digits, ""), lambda c: c.cast("int"))
    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _matches(pieces: DataFrame) -> DataFrame:
    """``row, kind, start, end, match, context, ok, refused``: positions, and what the rules say."""
    order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.where("kind is not null").withColumn("end", F.sum(F.col("before") + F.length("match")).over(order)).where("match <> ''")
    placed = placed.withColumn("start", F.col("end") - F.length("match"))
    digits = F.regexp_replace("match", "[^0-9]", "")
    long_enough = F.when(F.col("kind") == "card", F.length(digits).between(12, 19)).when(F.col("kind") == "phone", F.length(digits).between(9, 15) & (F.length("match") > 1)).when(F.col("kind") == "ip", F.contains("match", F.lit("."))).otherwise(True)
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255)
    holds = F.when(F.col("kind") == "card", F.when(long_enough, _luhn(digits))).when(F.col("kind") == "ip", F.when(long_enough, F.forall(F.split("match", "[.]"), small))).otherwise(True)
    placed = placed.withColumn("fits", long_enough).withColumn("ok", F.col("fits") & F.coalesce(holds, F.lit(False)))
    return placed.select("row", "kind", "start", "end", "match", "context", "ok", (F.col("fits") & ~F.col("ok")).alias("refused"))


def _occurrences(matches: DataFrame) -> DataFrame:
    """``row, start, end, x, pattern, kind``: identifier-like tokens with the word before; kind where a base span begins there."""
    t = matches.where("kind = 'token'")
    lead, tail = F.length(F.regexp_extract("match", _TRIM_LEFT, 0)), F.length(F.regexp_extract("match", _TRIM_RIGHT, 0))
    t = t.select("row", (F.col("start") + lead).cast("long").alias("start"), (F.col("end") - tail).cast("long").alias("end"), F.lower(F.regexp_replace(F.regexp_replace("match", _TRIM_LEFT, ""), _TRIM_RIGHT, "")).alias("x"), _spaced(F.regexp_extract("context", rf"({_PATTERN})\s*$", 1)).alias("pattern"))
    t = t.where((F.length("x") >= _CANDIDATE) | F.col("x").startswith("+")).where("pattern <> ''")
    spans = matches.where("kind <> 'token' and (ok or refused)").groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "ok", "match")).alias("spans"))
    joined = t.join(spans, "row", "left")
    joined = joined.withColumn("shaped", F.col("x").rlike(_SECRET_SHAPE))
    # what a rule accepted counts where it touches the token, unless inside a long one; what it refused, where it covers the token
    over = F.expr("filter(coalesce(spans, array()), s -> if(s.ok and not shaped, s.start < end and s.end > start, s.start <= start and s.end >= end))")
    begins = F.expr("filter(over, s -> s.ok and abs(s.start - start) <= 1)")
    joined = joined.withColumn("over", over).withColumn("begins", begins)
    # tokens inside a span, but not at its start, and what a rule refused say nothing
    joined = joined.where((F.size("over") == 0) | (F.size("begins") > 0))
    first = F.when(F.size("begins") > 0, F.col("begins")[0])
    # a seed's instance is the whole span, which may hold several tokens
    return joined.select("row", "start", "end", F.coalesce(F.lower(first["match"]), "x").alias("x"), "pattern", F.coalesce(first["kind"], F.when(F.col("shaped"), SECRET)).alias("kind"))


def _spaced(pattern):
    return F.lower(F.regexp_replace(pattern, r"\s+", " "))


def _totals(texts, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often the patterns occur in all texts."""
    every = texts.select(F.explode(F.regexp_extract_all("text", F.lit(_PATTERN), F.lit(0))).alias("p")).select(_spaced(F.col("p")).alias("pattern"))
    # counted before they move, as patterns repeat far more often than they differ; a semi join would be pushed below the count
    return every.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns.distinct(), "pattern")


def _pattern_scores(seen: DataFrame, texts: DataFrame, rounds: int, support: int) -> DataFrame:
    """``pattern, kind, score``: the confidence of every supported pattern in its best kind."""
    edges = seen.groupBy("pattern", "x").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    edges = stored(edges, "edges")
    # only patterns with as many instances can reach the support
    totals = stored(_totals(texts, edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")), "totals")
    seeds = edges.where("kind is not null").groupBy("x").agg(F.max("kind").alias("kind")).select("x", "kind", F.lit(1.0).alias("belief"))
    belief = seeds = stored(seeds, "seeds")
    scores = None
    for _ in range(rounds):
        believed = edges.drop("kind").join(belief, "x")
        mass = believed.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("mass"), F.sum(F.when(F.col("belief") >= 0.5, 1).otherwise(0)).alias("backing"))
        scored = mass.where(F.col("backing") >= support).join(totals, "pattern").select("pattern", "kind", F.least(F.lit(1.0), F.col("mass") / (F.col("total") + 1)).alias("score"))
        best = scored.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b")).select("pattern", "b.kind", "b.score")
        scores = stored(best, "scores")
        doubt = edges.where("kind is null").select("pattern", "x").join(scores, "pattern").groupBy("x", "kind").agg(F.sum(F.log1p(-F.least("score", F.lit(0.999999)))).alias("doubt"))
        new = doubt.groupBy("x").agg(F.min(F.struct("doubt", "kind")).alias("b")).select("x", "b.kind", (1 - F.exp("b.doubt")).alias("belief"))
        belief = stored(new.join(seeds, "x", "left_anti").unionByName(seeds.select("x", "kind", "belief")), "belief")
    return scores


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 5, confidence: float = 0.6) -> DataFrame:
    """``doc_id, base, added`` for every row: arrays of (start, end, kind, value), base and added spans by start, then kind."""
    pieces = stored(_pieces(docs, id_col, text_col), "pieces")
    matches = stored(_matches(pieces), "matches")
    seen = stored(_occurrences(matches), "occurrences")
    scores = _pattern_scores(seen, docs.select(F.col(text_col).alias("text")), rounds, support).where(F.col("score") >= confidence)
    added = seen.where(F.col("kind").isNull() | (F.col("kind") == SECRET)).drop("kind").join(scores, "pattern").select("row", "start", "end", "kind", F.col("x").alias("value"), F.lit(False).alias("base"))
    base = matches.where("ok and kind <> 'token'").select("row", F.col("start").cast("long"), F.col("end").cast("long"), "kind", F.col("match").alias("value"), F.lit(True).alias("base"))
    place = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind"))
    spans = base.unionByName(added).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "value", "base"))).alias("spans"))
    rows = pieces.where("pos is null or pos = 0").select("row", "doc_id")
    pick = lambda which: F.expr(f"transform(filter(coalesce(spans, array()), s -> {which}), s -> struct(s.start, s.end, s.kind, s.value))")
    return rows.join(spans, "row", "left").select("doc_id", pick("s.base").alias("base"), pick("not s.base").alias("added"), pick("true").alias("spans"))


def _joined(spans: str) -> "F.Column":
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("added").cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))

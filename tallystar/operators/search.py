"""Typo-tolerant title search, table by table.

Both sides are reduced to distinct strings first, so copies cost nothing. How pairs are found
then depends on the measured number and length of distinct titles:

* Up to ``inline_titles`` and a million characters: the titles travel as one array value (a scalar subquery), and each
  query row scores them inside its own row. Nothing is shuffled but the final top-k.
* Beyond that: strings meet only where they share a token, by an equi-join. Tokens are the
  characters of a string, numbered where they repeat, and a string joins by its rarest ones only.

A match with score >= t and lengths a and b has a common subsequence of n characters with
200*n >= t*(a + b). As n <= b, also n >= t*a/(200 - t): every match of a string shares that many
of its tokens. Of the shared tokens the rarest one then stands among the first
a - ceil(t*a/(200 - t)) + 1 of each string in order of rarity, so no match is lost.

Tokens can also be pairs of adjacent characters. Each character without a partner parts at most one pair, so a match shares at
least 3*n - a - b - 1 pairs, which is at least a*(3*t - 200)/(200 - t) - 1. Above two thirds of 100 this is a strong
filter, and the best matches are looked for by pairs first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystar.functions.similarity import characters, lcs_length, position_masks, ratio, sorted_tokens
from tallystar.functions.text import bind, like_pattern
from tallystar.session import scratch_path

# --- fixed values: search defaults ---

MATCH_LIMIT = 5
SEARCH_LIMIT = 20
SCORE_THRESHOLD = 60

# --- end of fixed values ---

INLINE_TITLES = 5_000
_INLINE_CHARS = 1_000_000
_TASKS_PER_CORE = 4
_BAG_BITS = 60
_SALTS = 16
GRAM = 3
# Scores at which pairs of characters still have to be shared: above two thirds of 100.
LEVELS = (90, 80, 70)


def _distinct_strings(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def _fits_inline(titles: DataFrame, most: int) -> bool:
    """Whether the distinct titles are few and short enough to travel inside one value."""
    seen = titles.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("name")).alias("chars")).first()
    return seen["n"] <= most and (seen["chars"] or 0) <= _INLINE_CHARS


def _with_features(df: DataFrame, column: str, p: str) -> DataFrame:
    """Sorted tokens, their characters, length and bag bits, computed once per string."""
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)

    def bag(word: int) -> Column:
        mine = F.filter(F.col(f"{p}_bag"), lambda b: (b >= word * _BAG_BITS) & (b < (word + 1) * _BAG_BITS))
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b - word * _BAG_BITS)))

    buckets = F.transform(
        _numbered(F.col(f"{p}_chars")), lambda c: F.pmod(F.xxhash64(c), F.lit(2 * _BAG_BITS)).cast("int")
    )
    return (
        df.withColumn(f"{p}_key", sorted_tokens(F.col(column)))
        .withColumn(f"{p}_chars", characters(F.col(f"{p}_key")))
        .withColumn(f"{p}_len", F.size(f"{p}_chars"))
        .withColumn(f"{p}_bag", buckets)
        .withColumn(f"{p}_bag0", bag(0))
        .withColumn(f"{p}_bag1", bag(1))
        .drop(f"{p}_bag")
    )


def _enough(lcs: Column, total: Column, threshold: int) -> Column:
    """Score test in whole numbers, free of rounding."""
    return F.lit(200) * lcs >= F.lit(threshold) * total


def _within_reach(a, b, threshold: int) -> Column:
    """Necessary tests, cheapest first: length gap, bag bits, bounded edit distance.

    ``a`` and ``b`` give a feature column by name. Every bit that differs stands for a
    character of one string without a partner in the other, and the edit distance never
    exceeds the number of such characters.
    """
    total = a("len") + b("len")
    slack = F.floor(F.lit(100 - threshold) * total / 100).cast("int")
    unlike = F.bit_count(a("bag0").bitwiseXOR(b("bag0"))) + F.bit_count(a("bag1").bitwiseXOR(b("bag1")))
    return (
        (F.abs(a("len") - b("len")) <= slack)
        & (unlike <= slack)
        & (F.call_function("levenshtein", a("key"), b("key"), slack) != -1)
    )


def _inline_matches(queries: DataFrame, titles: DataFrame, threshold: int, limit: int) -> DataFrame:
    # Scoring is heavy and its input small: a fixed count keeps adaptive execution from
    # merging the queries into a few tasks.
    tasks = _TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    q = _with_features(queries.repartition(tasks, "query"), "query", "q")
    q = q.withColumn("q_masks", position_masks(F.col("q_chars")))
    t = _with_features(titles, "name", "t")
    all_titles = t.agg(F.collect_list(F.struct("name", "t_key", "t_chars", "t_len", "t_bag0", "t_bag1")).alias("titles")).scalar()
    near = F.filter(
        F.col("titles"),
        lambda c: _within_reach(lambda f: F.col(f"q_{f}"), lambda f: c[f"t_{f}"], threshold),
    )
    scored = F.transform(
        near,
        lambda c: F.struct(
            lcs_length(F.col("q_masks"), F.col("q_len"), c["t_chars"]).alias("lcs"),
            c["t_len"].alias("t_len"),
            c["name"].alias("name"),
        ),
    )
    kept = F.filter(scored, lambda m: _enough(m["lcs"], F.col("q_len") + m["t_len"], threshold))
    best = F.slice(
        F.array_sort(
            F.transform(
                kept,
                lambda m: F.struct(
                    (-ratio(m["lcs"], F.col("q_len"), m["t_len"])).alias("order"), m["name"].alias("name")
                ),
            )
        ),
        1,
        limit,
    )
    return (
        q.withColumn("titles", all_titles)
        .select("query", F.posexplode(best).alias("pos", "m"))
        .select("query", F.col("m.name").alias("name"), (-F.col("m.order")).alias("score"), (F.col("pos") + 1).alias("rank"))
    )


def _numbered(items: Column) -> Column:
    """Tell repeated items apart, so that set operations count them."""
    return F.transform(
        items,
        lambda g, i: F.concat_ws(
            "\u0001", g, F.size(F.filter(F.slice(items, 1, i + 1), lambda x: x == g)).cast("string")
        ),
    )


def _pairs_of(chars: Column) -> Column:
    """Adjacent characters, two by two."""
    ends = F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0)))
    return F.zip_with(F.slice(chars, F.lit(1), F.size(ends)), ends, lambda a, b: F.concat(a, b))


def _tokens(chars: Column, pairs: bool) -> Column:
    return _numbered(_pairs_of(chars) if pairs else chars)


def _shared(length: Column, threshold: int, pairs: bool) -> Column:
    """How many tokens a string of this length shares with every match, whatever the length of the match."""
    if pairs:
        return F.ceil(F.lit(3 * threshold - 200) * length / F.lit(200 - threshold) - 1 - 1e-9)
    return F.ceil(F.lit(threshold) * length / F.lit(200 - threshold))


def _rare_prefix(df: DataFrame, column: str, p: str, frequency: DataFrame, threshold: int, pairs: bool) -> DataFrame:
    """Each string once per token of its prefix: its rarest tokens, enough for every match."""
    kept = [column, *[f"{p}_{f}" for f in ("key", "len", "bag0", "bag1")]]
    numbered = _with_features(df, column, p).select(*kept, _tokens(F.col(f"{p}_chars"), pairs).alias("tokens"))
    tokens = numbered.select(*kept, F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    rarest_first = Window.partitionBy(column).orderBy(F.coalesce("strings", F.lit(0)), "token")
    ranked = tokens.join(frequency, "token", "left").withColumn("place", F.row_number().over(rarest_first))
    shared = F.greatest(_shared(F.col(f"{p}_len"), threshold, pairs), F.lit(1))
    return ranked.where(F.col("place") <= F.col("size") - shared + 1).select(*kept, "token")


def _candidates(queries: DataFrame, titles: DataFrame, threshold: int, pairs: bool) -> DataFrame:
    """The pairs of strings that share a token of their prefixes and are within reach: query, name, q_key, t_key."""
    tokens_of = _with_features(titles, "name", "t").select(F.explode(_tokens(F.col("t_chars"), pairs)).alias("token"))
    frequency = tokens_of.groupBy("token").agg(F.count(F.lit(1)).alias("strings"))
    q = _rare_prefix(queries, "query", "q", frequency, threshold, pairs)
    if pairs:
        # A shorter query can have a match without a common pair.
        q = q.where(_shared(F.col("q_len"), threshold, pairs) >= 1)
    t = _rare_prefix(titles, "name", "t", frequency, threshold, pairs)
    # There are few distinct tokens and some are frequent, so each is split over several salts;
    # the fixed task count keeps adaptive execution from merging this small but heavy input.
    tasks = _TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    q = q.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(_SALTS)).cast("int")).repartition(tasks, "token", "salt")
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).repartition(tasks, "token", "salt")
    # A pair meets once per token its prefixes share. The cheap tests run inside the join, so
    # only pairs that pass them leave it, and those are made distinct before scoring.
    near = _within_reach(lambda f: F.col(f"q_{f}"), lambda f: F.col(f"t_{f}"), threshold)
    return q.join(t, (q["token"] == t["token"]) & (q["salt"] == t["salt"]) & near).select("query", "name", "q_key", "t_key").distinct()


def _token_matches(queries: DataFrame, titles: DataFrame, threshold: int, limit: int, pairs: bool = False) -> DataFrame:
    met = _candidates(queries, titles, threshold, pairs)
    both = F.struct(characters(F.col("q_key")).alias("q"), characters(F.col("t_key")).alias("t"))

    def measure(p: Column) -> Column:
        q_len, t_len = F.size(p["q"]), F.size(p["t"])
        common = bind(position_masks(p["q"]), lambda masks: lcs_length(masks, q_len, p["t"]))
        return F.struct(common.alias("lcs"), q_len.alias("q_len"), t_len.alias("t_len"))

    # Tested inside a generator: a filter on the result would be moved below it and would
    # compute the subsequence again for every character.
    enough = F.filter(
        F.array(bind(both, measure)), lambda m: _enough(m["lcs"], m["q_len"] + m["t_len"], threshold)
    )
    scored = met.select("query", "name", F.inline(enough)).select(
        "query", "name", ratio(F.col("lcs"), F.col("q_len"), F.col("t_len")).alias("score")
    )
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "name")
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= limit)


def _level_matches(queries: DataFrame, titles: DataFrame, threshold: int, limit: int) -> DataFrame:
    """Matches in a long list of titles, level by level of the score.

    At a high score a match shares most of its pairs of adjacent characters, and few strings do. A query with enough
    matches at a level is done: nothing below can rank before them. Only the others are asked at the next level, and only
    those that no level satisfies meet the titles by single characters.
    """
    def stored(frame: DataFrame) -> DataFrame:
        path = scratch_path(queries.sparkSession, "search-level")
        frame.write.parquet(path)
        return queries.sparkSession.read.schema(frame.schema).parquet(path)

    found, open_ = [], queries
    for level in LEVELS:
        if level > threshold:
            hits = stored(_token_matches(open_, titles, level, limit, pairs=True))
            done = hits.where(F.col("rank") == limit).select("query")
            found.append(hits.join(done, "query", "left_semi"))
            open_ = stored(open_.join(done, "query", "left_anti"))
    return reduce(DataFrame.unionByName, [*found, _token_matches(open_, titles, threshold, limit)])


def fuzzy_match(
    queries: DataFrame,
    titles: DataFrame,
    query: str = "query",
    title: str = "name",
    limit: int = MATCH_LIMIT,
    threshold: int = SCORE_THRESHOLD,
    inline_titles: int = INLINE_TITLES,
) -> DataFrame:
    """``query, name, score, rank`` of the best titles per distinct query string."""
    wanted = _distinct_strings(queries, query, "query").where("query != ''")
    known = _distinct_strings(titles, title, "name").where("name != ''")
    find = _inline_matches if _fits_inline(known, inline_titles) else _level_matches
    return find(wanted, known, threshold, limit)


def search_titles(
    queries: DataFrame,
    titles: DataFrame,
    query: str = "query",
    title: str = "name",
    restrict: Column | None = None,
    limit: int = SEARCH_LIMIT,
    threshold: int = SCORE_THRESHOLD,
    inline_titles: int = INLINE_TITLES,
) -> DataFrame:
    """Fuzzy hits per query, or titles that contain the text where a query has none.

    ``restrict`` narrows the titles of the fuzzy arm only, as occupation search does. An empty text has no
    fuzzy hit and is contained in every title. Hits are written once, because both arms need them.
    """
    narrowed = titles if restrict is None else titles.where(restrict)
    path = scratch_path(queries.sparkSession, "search-hits")
    found = fuzzy_match(queries, narrowed, query, title, limit, threshold, inline_titles)
    found.write.parquet(path)
    hits = queries.sparkSession.read.schema(found.schema).parquet(path)
    unmatched = _distinct_strings(queries, query, "query").join(hits.select("query").distinct(), "query", "left_anti")
    named = _distinct_strings(titles, title, "name").where("name != ''")
    contain = _inline_contains if _fits_inline(named, inline_titles) else contains_match
    contained = contain(unmatched, named, limit)
    return hits.select("query", "name", "rank", F.lit("fuzzy").alias("method")).unionByName(
        contained.withColumn("method", F.lit("contains"))
    )


def search_areas(queries: DataFrame, areas: DataFrame, query: str = "query", title: str = "name", **options) -> DataFrame:
    return search_titles(queries, areas, query, title, **options)


def search_occupations(
    queries: DataFrame, occupations: DataFrame, query: str = "query", title: str = "name",
    group: str = "o_group", detailed: str = "detailed", **options,
) -> DataFrame:
    return search_titles(queries, occupations, query, title, F.col(group) == detailed, **options)


def _containing(query: str) -> Column:
    return like_pattern(F.col(query))


def _inline_contains(queries: DataFrame, titles: DataFrame, limit: int) -> DataFrame:
    """As :func:`contains_match`, for titles that fit inside one value."""
    everything = titles.agg(F.collect_list("name").alias("titles")).scalar()
    found = F.filter(F.col("titles"), lambda n: F.ilike(n, _containing("query")))
    first = F.slice(F.array_sort(found), 1, limit)
    exploded = queries.withColumn("titles", everything).select("query", F.posexplode(first).alias("pos", "name"))
    return exploded.select("query", "name", (F.col("pos") + 1).alias("rank"))


def _grams(text: Column, n: Column) -> Column:
    """The different runs of ``n`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    runs = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))
    return F.when(F.length(text) >= n, runs).otherwise(F.array().cast("array<string>"))


def _first_names(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``key, name, rank`` of the first names of each key."""
    by_name = Window.partitionBy(key).orderBy("name")
    return rows.select(key, "name", F.row_number().over(by_name).alias("rank")).where(F.col("rank") <= limit)


def contains_match(queries: DataFrame, titles: DataFrame, limit: int) -> DataFrame:
    """``query, name, rank`` of the first titles by name that contain the query, ignoring case.

    Titles are indexed by their runs of three characters, or fewer where all literal parts of a query are shorter. A
    query meets only the posting list of its rarest run; wildcards are then tested in full. A query of one literal as
    long as a run is answered by the first names of its posting list, and one of wildcards alone by the first names of
    sufficient length, so that neither meets all titles.
    """
    parts = F.filter(F.split(F.lower("query"), "[%_]"), lambda p: p != "")
    n = F.least(F.lit(GRAM), F.coalesce(F.array_max(F.transform(parts, lambda p: F.length(p))), F.lit(0)))
    asked = queries.select("query", parts.alias("parts"), n.alias("n"))
    lengths = asked.where("n > 0").agg(F.collect_set("n").alias("n")).scalar()
    text = F.lower("name")
    postings = titles.withColumn("n", lengths).select(
        "name", F.explode(F.flatten(F.transform("n", lambda k: _grams(text, k)))).alias("gram"))

    whole = (F.col("n") > 0) & (F.lower("query") == F.get("parts", F.lit(0))) & (F.length(F.lower("query")) == F.col("n"))
    listed = asked.where(whole).select("query", F.lower("query").alias("gram"))
    first = _first_names(postings.join(listed.select("gram").distinct(), "gram", "left_semi"), "gram", limit)

    runs = F.array_distinct(F.flatten(F.transform("parts", lambda p: _grams(p, F.col("n")))))
    wanted = asked.where((F.col("n") > 0) & ~whole).select("query", F.explode(runs).alias("gram"))
    sizes = postings.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))
    # A run in no title has no size and is the rarest of all: its query finds nothing.
    rarest = wanted.join(sizes, "gram", "left").groupBy("query").agg(
        F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram")).alias("least"))
    met = rarest.select("query", F.col("least.gram").alias("gram")).join(postings, "gram").where(
        F.ilike("name", _containing("query")))

    # Only wildcards: each underscore stands for a character, so a title must have as many.
    least = (F.length("query") - F.length(F.replace(F.col("query"), F.lit("_"), F.lit("")))).alias("least")
    loose = asked.where("n = 0").select("query", least)
    by_length = _first_names(titles.withColumn("length", F.length("name")), "length", limit).drop("rank")
    longest = by_length.agg(F.max("length").alias("most")).scalar()
    reach = loose.select("least").distinct().withColumn("most", F.greatest(F.coalesce(longest, F.lit(0)), F.col("least")))
    enough = reach.select("least", F.explode(F.sequence("least", "most")).alias("length")).join(by_length, "length")
    return (
        listed.join(first, "gram").select("query", "name", "rank")
        .unionByName(_first_names(met, "query", limit))
        .unionByName(loose.join(_first_names(enough, "least", limit), "least").select("query", "name", "rank"))
    )

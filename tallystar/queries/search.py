"""Search queries: parts as occupations, nations as areas, misspelt names as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystar.functions.similarity import token_sort_ratio
from tallystar.functions.text import OCCUPATION_WORDS, extract_location, extract_occupation
from tallystar.operators import search
from tallystar.queries.tables import Query, table, tables

# A misspelt part name; the same text is valid in both dialects.
_TYPO = """CASE p_partkey % 6 WHEN 0 THEN p_name
  WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN replace(p_name, 'e', '')
  WHEN 3 THEN split_part(p_name, ' ', 2) || '  ' || split_part(p_name, ' ', 1)
  WHEN 4 THEN substr(p_name, 1, 4) ELSE p_name || ' ' || CAST(p_size AS STRING) END"""
_AREA_TYPO = """CASE c_custkey % 9 WHEN 0 THEN replace(n_name, 'NATION', 'NATIN') WHEN 1 THEN 'TION_' || CAST(n_nationkey AS STRING)
  WHEN 2 THEN 'ion_2' WHEN 3 THEN '' WHEN 4 THEN 'k' || chr(92) || 's' WHEN 5 THEN 'c' || chr(92) WHEN 6 THEN '%N_1%'
  WHEN 7 THEN 'o''brien "x"' ELSE 'nowhere' END"""


def token_sort_ratio_query(spark, sf_dir):
    typo = F.expr(_TYPO)
    score = token_sort_ratio(F.col("p_name"), F.concat_ws(" ", typo, "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score + 1e-7, 4).alias("score"))


def fuzzy_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = search.fuzzy_match(part.select(F.expr(_TYPO).alias("query")), part, "query", "p_name")
    return found.withColumn("score", F.round(F.col("score") + 1e-7, 4))


def search_areas(spark, sf_dir):
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    areas = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return search.search_areas(areas.select(F.expr(_AREA_TYPO).alias("query")), nation, "query", "n_name")


def search_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return search.search_occupations(
        part.select(F.expr(_TYPO).alias("query")), part, "query", "p_name", group="p_type", detailed="ECONOMY"
    )


_PLACE = """CASE c_custkey % 5 WHEN 0 THEN 'What are jobs in ' || n_name || ' and elsewhere?'
  WHEN 1 THEN 'Pay FOR ' || c_mktsegment || '-workers, o''brien at ' || n_name WHEN 2 THEN 'Who works at ' || n_name || ' or near ?'
  WHEN 3 THEN 'Jobs for us in winston-' || c_mktsegment || ', wa?!' ELSE n_name || ' jobs' END"""
_WORD_LIST = ", ".join(f"'{w}'" for w in OCCUPATION_WORDS)
_QUESTION = f"""CASE WHEN p_partkey % 16 < 13 THEN 'How much do ' || p_name || ' '
  || upper(array_item) || 's  and nurses make in ' || p_type ELSE p_name || ' pay' END"""
_SPARK_WORD = f"element_at(array({_WORD_LIST}), CAST(p_partkey % 13 + 1 AS INT))"
_DUCK_WORD = f"[{_WORD_LIST}][p_partkey % 13 + 1]"


def extract_location_query(spark, sf_dir):
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    asked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return asked.select("c_custkey", extract_location(F.expr(_PLACE)).alias("location"))


def extract_occupation_query(spark, sf_dir):
    question = F.expr(_QUESTION.replace("array_item", _SPARK_WORD))
    return table(spark, sf_dir, "part").select("p_partkey", extract_occupation(question).alias("occupation"))


def _sorted_tokens(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')), ' ')"


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, one table row per character of ``a``."""
    return f"""list_last(list_reduce(string_split({a}, ''), lambda prev, c:
      list_reduce(range(1, len({b}) + 1), lambda cur, j:
        list_append(cur, greatest(cur[j], prev[j + 1], prev[j] + CASE WHEN {b}[j] = c THEN 1 ELSE 0 END)),
      [CAST(0 AS BIGINT)]),
      list_transform(range(0, len({b}) + 1), lambda z: CAST(0 AS BIGINT))))"""


def _score_sql(pairs: str, columns: str) -> str:
    return f"""SELECT {columns}, a, b, {_lcs('a', 'b')} AS lcs FROM ({pairs})"""


def _matches_sql(queries: str, titles: str, limit: int) -> str:
    """Scored and ranked pairs of distinct strings with a score of at least 60."""
    return f"""
    all_asked AS (SELECT DISTINCT query FROM ({queries})), asked AS (SELECT query FROM all_asked WHERE query <> ''),
    known AS (SELECT DISTINCT name FROM ({titles}) WHERE name <> ''),
    pairs AS (SELECT query, name, {_sorted_tokens('query')} AS a, {_sorted_tokens('name')} AS b FROM asked, known),
    scored AS (SELECT query, name, 200.0 * {_lcs('a', 'b')} / (length(a) + length(b)) AS score FROM pairs WHERE a <> ''),
    hits AS (SELECT query, name, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS rank
      FROM scored WHERE score >= 60) WHERE rank <= {limit})"""


def _fallback_sql(titles: str, limit: int = 20) -> str:
    return f"""
    missed AS (SELECT query FROM all_asked WHERE query NOT IN (SELECT query FROM hits)),
    contained AS (SELECT query, name, row_number() OVER (PARTITION BY query ORDER BY name) AS rank
      FROM missed JOIN (SELECT DISTINCT name FROM ({titles})) ON name ILIKE '%' || query || '%')
    SELECT query, name, rank, 'fuzzy' AS method FROM hits
    UNION ALL SELECT query, name, CAST(rank AS INTEGER), 'contains' FROM contained WHERE rank <= {limit}"""


_PART_QUERIES = f"SELECT {_TYPO} AS query FROM part"
_PART_TITLES = "SELECT p_name AS name FROM part"
_DETAILED = "SELECT p_name AS name FROM part WHERE p_type = 'ECONOMY'"
_AREA_QUERIES = f"SELECT {_AREA_TYPO} AS query FROM customer JOIN nation ON c_nationkey = n_nationkey"
_AREA_TITLES = "SELECT n_name AS name FROM nation"

_PREP = "CASE WHEN contains(q, ' in ') THEN ' in ' WHEN contains(q, ' for ') THEN ' for ' WHEN contains(q, ' at ') THEN ' at ' END"

QUERIES = {
    "token_sort_ratio": Query(
        token_sort_ratio_query,
        f"""WITH pairs AS (SELECT p_partkey, {_sorted_tokens('p_name')} AS a,
          {_sorted_tokens(f"({_TYPO}) || ' ' || p_type")} AS b FROM part)
        SELECT p_partkey, round(200.0 * {_lcs('a', 'b')} / (length(a) + length(b)) + 1e-7, 4) AS score FROM pairs""",
    ),
    "fuzzy_match": Query(
        fuzzy_match,
        f"""WITH {_matches_sql(_PART_QUERIES, _PART_TITLES, 5)}
        SELECT query, name, round(score + 1e-7, 4) AS score, rank FROM hits""",
    ),
    "search_areas": Query(
        search_areas, f"WITH {_matches_sql(_AREA_QUERIES, _AREA_TITLES, 20)}, {_fallback_sql(_AREA_TITLES)}"
    ),
    "search_titles": Query(
        search_titles, f"WITH {_matches_sql(_PART_QUERIES, _DETAILED, 20)}, {_fallback_sql(_PART_TITLES)}"
    ),
    "extract_location": Query(
        extract_location_query,
        f"""WITH asked AS (SELECT c_custkey, lower({_PLACE}) AS q FROM customer JOIN nation ON c_nationkey = n_nationkey),
        cut AS (SELECT c_custkey, split_part(split_part(trim(split_part(q, {_PREP}, 2), ' ?.!,'), ' and', 1), ' or', 1) AS place,
          {_PREP} AS prep FROM asked)
        SELECT c_custkey, CASE WHEN prep IS NOT NULL THEN array_to_string(list_transform(
          regexp_extract_all(place, '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '') END AS location FROM cut""",
    ),
    "extract_occupation": Query(
        extract_occupation_query,
        f"""WITH asked AS (SELECT p_partkey, string_split_regex(lower({_QUESTION.replace('array_item', _DUCK_WORD)}), '\\s+') AS words,
          CASE WHEN p_partkey % 16 < 13 THEN list_filter([{_WORD_LIST}],
            lambda k: contains(lower({_QUESTION.replace('array_item', _DUCK_WORD)}), k))[1] END AS keyword FROM part),
        placed AS (SELECT *, list_position(list_transform(words, lambda w: contains(w, keyword)), true) AS spot FROM asked)
        SELECT p_partkey, CASE WHEN keyword IS NOT NULL
          THEN array_to_string(words[greatest(spot - 2, 1):spot], ' ') END AS occupation FROM placed""",
    ),
}

"""Threat screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import text as X
from veilgrain.operators import screen
from veilgrain.plans import views as V

Q = {}
SQL = {}

_DECOMPOSED = {
    "é": "é", "è": "è", "ê": "ê", "ç": "ç", "ñ": "ñ", "ó": "ó", "í": "í",
    "ü": "ü", "ä": "ä", "ö": "ö", "É": "É", "È": "È", "Ñ": "Ñ", "Ó": "Ó",
    "Ç": "Ç", "Ä": "Ä", "Ü": "Ü", "Ê": "Ê", "Ö": "Ö", "Í": "Í",
}


def norm_sql(expr: str) -> str:
    """SQL twin of the normalisation for the letters these tables hold."""
    out = expr
    for composed in _DECOMPOSED:
        base, mark = __import__("unicodedata").normalize("NFD", composed)
        out = f"replace({out}, '{composed}', '{base}' || chr({ord(mark)}))"
    return f"trim(lower(translate({out}, '{''.join(K.HOMOGLYPHS)}', '{''.join(K.HOMOGLYPHS.values())}')), E' \\t\\n\\r')"


def ascii_norm_sql(expr: str) -> str:
    return f"trim(lower(translate({expr}, '013458', 'oleasb')))"


def any_sql(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in terms) + ")"


Q["normalise_text"] = lambda spark, d: screen.normalise_text(
    V.table(spark, d, "documents").select("doc_id", "text")
).select("doc_id", "normalised")
SQL["normalise_text"] = f"SELECT doc_id, {norm_sql('text')} AS normalised FROM documents"

WORDS = ("thther", "eaux", "nicht", "corr", "erth", "ou 1e", "the 3nd", "stre", "zzz")


def screen_keywords(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return screen.screen_keywords(docs, "text", WORDS).select(
        "doc_id", "flagged", F.array_join("matched", "|").alias("matched")
    )


Q["screen_keywords"] = screen_keywords
_TERMS = [X.normalise_literal(w) for w in WORDS]
SQL["screen_keywords"] = f"""SELECT doc_id, len(m) > 0 AS flagged, coalesce(array_to_string(m, '|'), '') AS matched FROM (
  SELECT doc_id, list_filter({_TERMS!r}, lambda t: contains(n, t)) AS m FROM (SELECT doc_id, {norm_sql('text')} AS n FROM documents))"""


def _words(text: str):
    return F.explode(F.array_distinct(F.split(F.regexp_replace(X.normalise_text(F.col(text)), r"[^\p{L}\p{N}_]+", " "), " ")))


def screen_term_table(spark, d):
    terms = V.table(spark, d, "benchmark").select(_words("text").alias("term")).filter(F.length("term") >= 9)
    return screen.screen_term_table(V.table(spark, d, "documents"), ["doc_id"], terms)


Q["screen_term_table"] = screen_term_table
_SPLIT = "SELECT {key}, unnest(string_split_regex({norm}, '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM {table}"
SQL["screen_term_table"] = f"""WITH d AS ({_SPLIT.format(key='doc_id', norm=norm_sql('text'), table='documents')}),
  b AS ({_SPLIT.format(key='item_id', norm=norm_sql('text'), table='benchmark')})
  SELECT DISTINCT doc_id, term FROM d WHERE term IN (SELECT term FROM b WHERE length(term) >= 9)"""

Q["screen_goal_rules"] = lambda spark, d: screen.screen_goal_rules(V.actions(spark, d), V.anchors(spark, d)).select(
    "action_id", "goal_rule_hit"
)
GOAL_HIT_SQL = f"""(goal = 'flight_booking' AND ({any_sql(ascii_norm_sql('reasoning'), K.GOAL_REASONING_TERMS['flight_booking'])}
  OR {any_sql(ascii_norm_sql('value'), K.GOAL_VALUE_TERMS['flight_booking'])}))"""
SQL["screen_goal_rules"] = V.with_views(
    ["actions", "anchors"],
    f"SELECT action_id, {GOAL_HIT_SQL} AS goal_rule_hit FROM actions JOIN anchors USING (task_id)",
)


def hit_sql(compat: bool, what: str) -> str:
    arms = " ".join(
        f"WHEN contains({ascii_norm_sql('reasoning')}, '{t}') OR contains({ascii_norm_sql('value')}, '{t}') THEN '{c if what == 'cls' else t}'"
        for c, t in screen.class_terms(compat)
    )
    return f"(CASE {arms} END)"


def _forbidden(compat):
    def run(spark, d):
        out = screen.screen_forbidden_classes(V.actions(spark, d), compat)
        return out.select("action_id", "forbidden_class", "forbidden_term")

    return run


for _name, _compat in (("screen_forbidden_classes", False), ("screen_forbidden_classes_compat", True)):
    Q[_name] = _forbidden(_compat)
    SQL[_name] = V.with_views(
        ["actions"],
        f"SELECT action_id, {hit_sql(_compat, 'cls')} AS forbidden_class, {hit_sql(_compat, 'term')} AS forbidden_term FROM actions",
    )


def screen_url_scheme(spark, d):
    heads = ("", "javascript:go ", "x;base64,", "data:text/html,")
    url = F.concat(V._pick(heads, F.col("page_id") % 4), F.col("url"))
    pages = V.table(spark, d, "pages").select("page_id", url.alias("url"))
    return screen.screen_url_scheme(pages).select("page_id", "forbidden_scheme")


Q["screen_url_scheme"] = screen_url_scheme
SQL["screen_url_scheme"] = """SELECT page_id, page_id % 4 <> 0 OR contains(lower(url), 'base64') OR contains(lower(url), 'data:text/html')
    OR starts_with(lower(url), 'data:') AS forbidden_scheme FROM pages"""

Q["screening_report"] = lambda spark, d: screen.screening_report(V.prompts(spark, d))
SQL["screening_report"] = V.with_views(
    ["prompts"],
    f"""SELECT vector, count(*) AS cases, count(*) FILTER (is_attack) AS attacks, count(*) FILTER (is_attack AND f) AS attacks_flagged,
      count(*) FILTER (NOT is_attack AND f) AS benign_flagged,
      CASE WHEN count(*) FILTER (is_attack) > 0 THEN round(count(*) FILTER (is_attack AND f) * 100.0 / count(*) FILTER (is_attack), 2) END AS recall_pct,
      CASE WHEN count(*) FILTER (NOT is_attack) > 0 THEN round(count(*) FILTER (NOT is_attack AND f) * 100.0 / count(*) FILTER (NOT is_attack), 2) END AS false_positive_pct,
      round(count(*) FILTER (is_attack AND NOT f) * 100.0 / count(*), 2) AS unsafe_pct
    FROM (SELECT *, {any_sql(norm_sql('prompt'), [X.normalise_literal(t) for t in K.PROMPT_SCREEN_TERMS])} AS f FROM prompts)
    GROUP BY ROLLUP (vector)""",
)

"""Queries over fault classes and labels of validated candidates, with their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinworks.functions.storage import checkpointed
from veinworks.operators import mapping
from veinworks.operators.mapping import CLAIM, Pattern
from veinworks.operators.validation import redirected
from veinworks.plans.bindings import table
from veinworks.plans.catalogue import ORACLES, QUERIES, query
from veinworks.plans.catalogue_candidates import _CANDIDATES, _RULES, _TURNED, _candidates

PATTERNS = [Pattern("F8", "p0", "causes?[^a-z]"), Pattern("F9", "p1", "r[a-z]+g|bolt", CLAIM)]
VETOES = [("F1", "is a sign of"), ("F8", "anvil")]
ELIGIBLE = ("human_approved", "secondary_ai_verified", "source_zh_exact", "dictionary_approved")
RELATIONS = {"causes": "导致", "indicates": "表明", "detects": "检测"}
PROTECTED = "gear|ring"

_ALIAS = {
    "fault_id": "concat('F', p_size % 4)",
    "rule_id": "concat('a', p_partkey)",
    "alias": "CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN upper(split_part(p_name, ' ', 2)) ELSE concat(split_part(p_name, ' ', 1), ' Causes') END",
}
_TERM = {
    "type": "CASE p_partkey % 2 WHEN 0 THEN 'fault' ELSE 'cause' END",
    "surface": "CASE p_partkey % 3 WHEN 0 THEN upper(split_part(p_name, ' ', 2)) WHEN 1 THEN concat(' ', split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 2) END",
    "term_id": "concat('T', p_partkey)",
    "label": "CASE p_partkey % 5 WHEN 0 THEN concat('环', p_size) WHEN 1 THEN 'no han' WHEN 2 THEN concat('故障 ', split_part(p_name, ' ', 2)) ELSE ' 齿轮 gear ' END",
    "status": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'human_approved' WHEN 2 THEN 'secondary_ai_verified' ELSE 'draft' END",
}
_PROPOSED = {
    "head_proposed": "CASE candidate_id % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('热', head) WHEN 2 THEN head ELSE ' 冷 ' END",
    "head_proposed_status": "CASE candidate_id % 4 WHEN 0 THEN 'human_approved' WHEN 1 THEN 'draft' ELSE NULL END",
    "tail_proposed": "CASE candidate_id % 7 WHEN 0 THEN '' WHEN 1 THEN concat('坏 ', tail) WHEN 2 THEN concat('环 ', tail) ELSE tail END",
    "tail_proposed_status": "CASE candidate_id % 3 WHEN 0 THEN 'secondary_ai_verified' ELSE NULL END",
}
#: Every fifteenth head has Han letters, which the parts' names lack.
_HEAD = "CASE WHEN candidate_id % 15 = 4 THEN concat('环 ', head) ELSE head END"

_columns = lambda of: ", ".join(f"{e} AS {n}" for n, e in of.items())



_BASE = f"""{_CANDIDATES}, {_TURNED}, v AS ({ORACLES['validated_candidates']}), b0 AS (SELECT v.* REPLACE ({_HEAD.replace('head', 'v.head')} AS head), t.head_type, t.tail_type, t.evidence FROM v JOIN turned t USING (candidate_id)), base AS (SELECT *, {_columns(_PROPOSED)} FROM b0),
aliases AS (SELECT {_columns(_ALIAS)} FROM part WHERE p_partkey % 97 = 0), terms AS (SELECT {_columns(_TERM)} FROM part WHERE p_partkey % 50 IN (3, 8)),
texts AS (SELECT candidate_id, concat_ws(chr(10), nullif(head, ''), nullif(tail, '')) AS claim, concat_ws(chr(10), nullif(head, ''), nullif(tail, ''), nullif(evidence, '')) AS whole FROM base),
raw_hits AS (SELECT candidate_id, fault_id, rule_id, length(regexp_extract(whole, '(?is)^(.*?)\\b' || alias || '\\b', 1)) AS start, length(alias) AS n, whole AS text, 'claim_and_evidence' AS scope FROM texts, aliases WHERE regexp_matches(whole, '(?is)\\b' || alias || '\\b')
  {' '.join(f"UNION ALL SELECT candidate_id, '{p.fault_id}', '{p.rule_id}', length(regexp_extract(t, '(?is)^(.*?)(?:{p.pattern})', 1)), length(regexp_extract(t, '(?is)(?:{p.pattern})')), t, '{p.scope}' FROM (SELECT candidate_id, {'claim' if p.scope == CLAIM else 'whole'} AS t FROM texts) WHERE regexp_matches(t, '(?is)(?:{p.pattern})')" for p in PATTERNS)}),
barred AS ({' UNION '.join(f"SELECT candidate_id, '{f}' AS fault_id FROM texts WHERE regexp_matches(whole, '(?is){p}')" for f, p in VETOES)}),
hits AS (SELECT candidate_id, fault_id, rule_id, CAST(start AS integer) AS start, CAST(start + n AS integer) AS "end", substr(text, start + 1, n) AS matched, scope FROM raw_hits ANTI JOIN barred USING (candidate_id, fault_id))"""


def _base(spark, sf_dir):
    done = QUERIES["validated_candidates"](spark, sf_dir)
    rows = redirected(_candidates(spark, sf_dir), _RULES).select("candidate_id", "head_type", "tail_type", "evidence")
    base = done.join(rows.hint("merge"), "candidate_id").withColumn("head", F.expr(_HEAD))
    return checkpointed(base.withColumns({n: F.expr(e) for n, e in _PROPOSED.items()}))


def _hits(spark, sf_dir, base, by_rule=False):
    parts = table(spark, sf_dir, "part")
    aliases = parts.where("p_partkey % 97 = 0").selectExpr(*(f"{e} AS {n}" for n, e in _ALIAS.items()))
    return mapping.fault_hits(base, aliases, PATTERNS, VETOES, by_rule)


@query(f"WITH {_BASE} SELECT * FROM hits")
def fault_hits(spark, sf_dir):
    return _hits(spark, sf_dir, _base(spark, sf_dir), by_rule=True)


@query(f"WITH {_BASE} SELECT candidate_id, start, \"end\", matched, array_to_string(list_sort(list(DISTINCT fault_id)), ',') AS fault_ids FROM hits GROUP BY candidate_id, start, \"end\", matched HAVING count(DISTINCT fault_id) > 1")
def ambiguous_faults(spark, sf_dir):
    found = mapping.ambiguous(_hits(spark, sf_dir, _base(spark, sf_dir)))
    return found.withColumn("fault_ids", F.array_join("fault_ids", ","))


_EVEN = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_HAN = "[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]".replace("{{", "{").replace("}}", "}")
_DIGEST = "concat('{0}-', substr(sha256(concat_ws('␟', {1})), 1, 20))"


def _side_sql(side: str, source: str) -> str:
    """The columns of an endpoint, in steps, as a chain of subqueries over ``source``."""
    even = _EVEN.format
    return f"""(SELECT *, list_filter([CASE WHEN k IS NOT NULL AND p IS NOT NULL AND {even('p')} <> {even(f'{side}_label')} THEN '{mapping.OVERRIDDEN}' END, CASE WHEN coalesce({side}_label, '') = '' THEN '{mapping.MISSING}' WHEN NOT regexp_matches({side}_label, '{_HAN}') THEN '{mapping.NO_HAN}' END,
  CASE WHEN lost THEN '{mapping.PROTECTED}' END, CASE WHEN NOT fits THEN '{mapping.STATUS}' END], lambda r: r IS NOT NULL) AS {side}_why, coalesce(regexp_matches({side}_label, '{_HAN}'), false) AND {side}_term IS NOT NULL AND NOT lost AND fits AS {side}_ready
FROM (SELECT *, CASE WHEN k IS NOT NULL THEN CASE {side}_status WHEN 'secondary_ai_verified' THEN 'secondary_ai_verified' WHEN 'human_approved' THEN 'human_reviewed' WHEN 'source_zh_exact' THEN 'source_zh_exact' ELSE 'type_scoped_dictionary' END WHEN own AND {even(f'{side}_label')} = {even(side)} THEN 'source_zh_exact' ELSE 'proposed:' || {side}_status END AS {side}_method,
  CASE WHEN k IS NOT NULL THEN k.term_id WHEN regexp_matches({side}_label, '{_HAN}') THEN {_DIGEST.format('TERM', f"{side}_type, {even(f'{side}_label')}")} END AS {side}_term, {side}_status IN {ELIGIBLE} AS fits,
  len(list_filter(regexp_extract_all(lower({side}), '{PROTECTED}'), lambda w: NOT coalesce(contains({even(f'{side}_label')}, w), false))) > 0 AS lost
FROM (SELECT *, CASE WHEN k IS NOT NULL THEN coalesce(k.status, 'dictionary_approved') WHEN own AND {even(f'{side}_label')} = {even(side)} THEN 'source_zh_exact' ELSE coalesce(said, 'needs_review') END AS {side}_status
FROM (SELECT *, CASE WHEN k IS NOT NULL THEN trim(k.label) WHEN own THEN coalesce(p, trim({side})) ELSE p END AS {side}_label
FROM (SELECT b.*, k, k IS NULL AND regexp_matches({side}, '{_HAN}') AS own, nullif(trim({side}_proposed), '') AS p, nullif(trim({side}_proposed_status), '') AS said FROM {source} b
  LEFT JOIN (SELECT type, {even('surface')} AS s, arg_min({{'term_id': term_id, 'label': label, 'status': status}}, term_id) AS k FROM terms GROUP BY ALL) x ON x.type = {side}_type AND x.s = {even(side)})))))"""


_DESCRIBED = f"""WITH {_BASE}, first_side AS (SELECT * EXCLUDE (k, own, p, said, lost, fits) FROM {_side_sql('head', 'base')}), both_sides AS (SELECT * EXCLUDE (k, own, p, said, lost, fits) FROM {_side_sql('tail', 'first_side')}),
classes AS (SELECT candidate_id, array_to_string(list_sort(list(DISTINCT fault_id)), ',') AS fault_ids FROM hits GROUP BY candidate_id),
named AS (SELECT *, CASE relation {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATIONS.items())} END AS relation_label, {_DIGEST.format('ENT', f"head_type, coalesce(head_term, {_EVEN.format('head')})")} AS head_entity_id, {_DIGEST.format('ENT', f"tail_type, coalesce(tail_term, {_EVEN.format('tail')})")} AS tail_entity_id FROM both_sides),
told AS (SELECT *, list_concat(head_why, tail_why, CASE WHEN relation_label IS NULL THEN ['relation_zh_label_missing'] ELSE [] END) AS why FROM named)
SELECT candidate_id, decision, coalesce(fault_ids, '') AS fault_ids, head_label, head_term, head_method, head_status, tail_label, tail_term, tail_method, tail_status, relation_label, head_ready AND tail_ready AND relation_label IS NOT NULL AS ready,
  array_to_string(list_filter(why, lambda x, i: list_position(why, x) = i), ',') AS label_reasons, head_entity_id, tail_entity_id, {_DIGEST.format('CLAIM', 'head_entity_id, relation, tail_entity_id')} AS claim_id FROM told LEFT JOIN classes USING (candidate_id)"""


@query(_DESCRIBED)
def described_candidates(spark, sf_dir):
    """Candidates through the whole validation: rewritten, typed, placed, entailed, decided, mapped to faults, labelled and given ids."""
    base = _base(spark, sf_dir)
    terms = table(spark, sf_dir, "part").where("p_partkey % 50 IN (3, 8)").selectExpr(*(f"{e} AS {n}" for n, e in _TERM.items()))
    told = mapping.described(base, _hits(spark, sf_dir, base), terms, ELIGIBLE, RELATIONS, PROTECTED)
    wanted = "candidate_id decision head_label head_term head_method head_status tail_label tail_term tail_method tail_status relation_label ready head_entity_id tail_entity_id claim_id".split()
    return told.select(*wanted, *(F.array_join(c, ",").alias(c) for c in ("fault_ids", "label_reasons")))

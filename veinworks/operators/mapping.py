"""Fault classes of validated candidates, by aliases with offsets and scoped patterns, and their labels by a ladder of sources."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinworks.operators.identity import normalised, stable_id
from veinworks.operators.lexical import HAN

#: Characters of aliases in one automaton; more aliases take further passes over the texts.
ALIAS_CHARS = 8_000_000
#: A task hands on its hits as soon as it holds so many.
HITS = 50_000
CLAIM, WHOLE = "claim_only", "claim_and_evidence"
#: Why an endpoint has no label that may be shown, and how it came by the label it has.
MISSING, NO_HAN, PROTECTED, STATUS = "canonical_zh_missing", "canonical_zh_has_no_han_character", "protected_term_missing_from_canonical_zh", "translation_status_not_graph_eligible"
OVERRIDDEN, ID_OVERRIDDEN = "model_label_overridden_by_dictionary", "model_terminology_id_overridden_by_dictionary"
SOURCE, UNREVIEWED = "source_zh_exact", "needs_review"
METHODS = {"secondary_ai_verified": "secondary_ai_verified", "human_approved": "human_reviewed", SOURCE: SOURCE}


@dataclass(frozen=True)
class Pattern:
    fault_id: str
    rule_id: str
    pattern: str
    scope: str = WHOLE


def _lines(*parts: str) -> Column:
    """The parts that aren't empty, a line each."""
    return F.concat_ws("\n", *(F.when(F.col(p) != "", F.col(p)) for p in parts))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _lowered(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _alike(known: list) -> tuple[dict[str, list[int]], list[tuple[int, str, str]]]:
    """Aliases with the numbers of their groups, and the groups' members (number, fault_id, rule_id): rules of one fault with the same aliases hit the same places, so they are one group."""
    of: dict[tuple[str, str], set[str]] = {}
    for r in known:
        of.setdefault((r["fault_id"], r["rule_id"]), set()).add(_lowered(r["alias"]))
    numbers: dict[tuple[str, frozenset[str]], int] = {}
    members = [(numbers.setdefault((fault, frozenset(texts)), len(numbers)), fault, rule) for (fault, rule), texts in of.items()]
    groups: dict[str, list[int]] = {}
    for (_, texts), n in numbers.items():
        for alias in texts:
            groups.setdefault(alias, []).append(n)
    return groups, members


def _group_hits(rows: DataFrame, aliases: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each slice of the aliases: (candidate_id, group, fault_id, start, end, matched, scope), and the groups' members (group, rule_id)."""
    known = aliases.where(F.trim("alias") != "").select("fault_id", "rule_id", F.trim("alias").alias("alias"))
    slices = max(1, -(-int(known.agg(F.sum(F.char_length("alias"))).first()[0] or 0) // ALIAS_CHARS))
    texts = rows.select("candidate_id", _lines("head", "tail", "evidence").alias("text")).where("text <> ''")
    kind = rows.schema["candidate_id"].dataType.simpleString()
    schema = f"candidate_id {kind}, group int, fault_id string, start int, end int, matched string, scope string"
    out = []
    for k in range(slices):
        groups, members = _alike(known.where(F.pmod(F.xxhash64("alias"), F.lit(slices)) == k).collect())
        faults = {n: fault for n, fault, _ in members}

        def find(batches: Iterator[pa.RecordBatch], groups: dict = groups, faults: dict = faults) -> Iterator[pa.RecordBatch]:
            found = ahocorasick.Automaton()
            for alias, of in groups.items():
                found.add_word(alias, (len(alias), of))
            found.make_automaton()

            def told(batch: pa.RecordBatch, hits: list[tuple]) -> pa.RecordBatch:
                row, group, start, end, matched = zip(*hits, strict=True) if hits else ([],) * 5
                return pa.RecordBatch.from_arrays(
                    [batch.column("candidate_id").take(pa.array(row, pa.int64())), pa.array(group, pa.int32()), pa.array([faults[g] for g in group], pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(matched, pa.string()), pa.array([WHOLE] * len(row), pa.string())],
                    names=["candidate_id", "group", "fault_id", "start", "end", "matched", "scope"],
                )

            for batch in batches:
                hits: list[tuple] = []
                for i, text in enumerate(batch.column("text").to_pylist() if groups else []):
                    seen: set[int] = set()
                    for last, (n, of) in found.iter(_lowered(text)):
                        start, end = last + 1 - n, last + 1
                        if (start == 0 or not _word(text[start - 1])) and (end == len(text) or not _word(text[end])):
                            new = [g for g in of if g not in seen]
                            seen.update(new)
                            hits.extend((i, g, start, end, text[start:end]) for g in new)
                    if len(hits) >= HITS:
                        yield told(batch, hits)
                        hits = []
                yield told(batch, hits)

        out.append((texts.mapInArrow(find, schema), rows.sparkSession.createDataFrame([(n, rule) for n, _, rule in members], "group int, rule_id string")))
    return out


def _by_rule(hits: DataFrame, members: DataFrame) -> DataFrame:
    # the automaton's rules go to the hits, as it did itself; Spark takes hits for as small as their texts and would gather them in the driver
    return hits.join(F.broadcast(members), "group").select("candidate_id", "fault_id", "rule_id", "start", "end", "matched", "scope")


def alias_hits(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(candidate_id, fault_id, rule_id, start, end, matched, scope): the first word-bounded occurrence of each alias (fault_id, rule_id, alias) in head, tail and evidence.

    One automaton finds all aliases in one pass over a text, however many there are. It is sent to every task, so the
    aliases are dealt by a hash into slices of ALIAS_CHARS characters, each with a pass of its own. A pass finds groups of
    rules with the same aliases; the rules themselves are joined to what it found.
    """
    return reduce(DataFrame.unionByName, (_by_rule(*of) for of in _group_hits(rows, aliases)))


def fault_hits(rows: DataFrame, aliases: DataFrame, patterns: list[Pattern], vetoes: list[tuple[str, str]], by_rule: bool = True) -> DataFrame:
    """The hits of aliases and of patterns (a short list, each in its scope) of the faults that no veto (fault_id, pattern) excludes for the candidate.

    Without ``by_rule`` the hits of rules with the same fault and aliases are one row, and rule_id is left out: enough for
    the faults of a candidate, and no more rows than places and faults, however many rules share an alias.
    """
    claim, whole = _lines("head", "tail"), _lines("head", "tail", "evidence")
    texts = rows.select("candidate_id", claim.alias("_claim"), whole.alias("_whole"))
    barred = None
    if vetoes:
        barred = texts.select("candidate_id", F.explode(F.array_compact(F.array(*(F.when(F.col("_whole").rlike(f"(?is){p}"), F.lit(f)) for f, p in vetoes)))).alias("fault_id")).distinct()
    # vetoes come before the rules are joined, while a place is one row; they grow with the candidates, so both are shuffled
    allowed = lambda hits: hits if barred is None else hits.join(barred.hint("merge"), ["candidate_id", "fault_id"], "left_anti")
    every = ["candidate_id", "fault_id", *(["rule_id"] if by_rule else []), "start", "end", "matched", "scope"]
    parts = [_by_rule(allowed(found), members) if by_rule else allowed(found).select(*every) for found, members in _group_hits(rows, aliases)]
    if patterns:

        def hit(p: Pattern) -> Column:
            text = F.col("_claim" if p.scope == CLAIM else "_whole")
            matched = F.regexp_substr(text, F.lit(f"(?is)(?:{p.pattern})"))
            start = F.char_length(F.regexp_extract(text, f"(?is)^(.*?)(?:{p.pattern})", 1))
            return F.when(matched.isNotNull(), F.struct(F.lit(p.fault_id).alias("fault_id"), F.lit(p.rule_id).alias("rule_id"), start.cast("int").alias("start"), (start + F.char_length(matched)).cast("int").alias("end"), matched.alias("matched"), F.lit(p.scope).alias("scope")))

        found = texts.select("candidate_id", F.inline(F.array_compact(F.array(*(hit(p) for p in patterns)))))
        parts.append(allowed(found).select(*every))
    return reduce(DataFrame.unionByName, parts)


def fault_classes(hits: DataFrame) -> DataFrame:
    """(candidate_id, fault_ids, rules): the faults and rules that hit each candidate, in order; only the faults where the hits are not by rule."""
    listed = {"fault_ids": "fault_id", "rules": "rule_id"}
    return hits.groupBy("candidate_id").agg(*(F.array_sort(F.collect_set(c)).alias(n) for n, c in listed.items() if c in hits.columns))


def ambiguous(hits: DataFrame) -> DataFrame:
    """(candidate_id, start, end, matched, fault_ids): the same place taken by several faults, as violations."""
    per = hits.groupBy("candidate_id", "start", "end", "matched").agg(F.array_sort(F.collect_set("fault_id")).alias("fault_ids"))
    return per.where(F.size("fault_ids") > 1)


def has_han(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{HAN}]"), F.lit(False))


def labelled_side(rows: DataFrame, side: str, terms: DataFrame, eligible: tuple[str, ...], protected: str | None = None) -> DataFrame:
    """Add ``<side>_label``, ``_term``, ``_method``, ``_status``, ``_ready`` and ``_why`` for the endpoint ``side`` with ``<side>_type``.

    The first of three sources counts: a term of the dictionary (type, surface, term_id, label, status) for the type and
    the normalised surface; a surface with Han letters as it is, unless a label is proposed; the proposal
    (``<side>_proposed``, ``<side>_proposed_status``). A dictionary that knows a surface twice counts by its least term.
    ``protected`` is a pattern of words that a label has to keep.
    """
    surface, kind = F.col(side), F.col(f"{side}_type")
    proposed, said = (F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in (f"{side}_proposed", f"{side}_proposed_status"))
    once = terms.groupBy(F.col("type").alias("_type"), normalised(F.col("surface")).alias("_surface")).agg(F.min(F.struct("term_id", "label", "status")).alias("_known"))
    met = rows.join(once, (kind == F.col("_type")) & (normalised(surface) == F.col("_surface")), "left")
    known = F.col("_known").isNotNull()
    same = lambda a, b: F.coalesce(normalised(a) == normalised(b), F.lit(False))
    by_source = ~known & has_han(surface)
    label = F.when(known, F.trim(F.col("_known.label"))).when(by_source, F.coalesce(proposed, F.trim(surface))).otherwise(proposed)
    status = F.when(known, F.coalesce(F.col("_known.status"), F.lit("dictionary_approved"))).when(by_source & same(label, surface), SOURCE).otherwise(F.coalesce(said, F.lit(UNREVIEWED)))
    method = F.lit("type_scoped_dictionary")
    for s, m in METHODS.items():
        method = F.when(status == s, m).otherwise(method)
    method = F.when(known, method).when(by_source & same(label, surface), SOURCE).otherwise(F.concat(F.lit("proposed:"), status))
    term = F.when(known, F.col("_known.term_id")).when(has_han(label), stable_id("TERM", kind, normalised(label)))
    words = F.array() if protected is None else F.coalesce(F.regexp_extract_all(F.lower(surface), F.lit(f"({protected})"), F.lit(1)), F.array().cast("array<string>"))
    lost = F.exists(words.cast("array<string>"), lambda w: ~F.coalesce(F.contains(normalised(label), w), F.lit(False)))
    fits = F.coalesce(status.isin(*eligible), F.lit(False))
    why = F.array_compact(F.array(
        F.when(known & proposed.isNotNull() & ~same(proposed, label), OVERRIDDEN),
        F.when(label.isNull() | (label == ""), MISSING).when(~has_han(label), NO_HAN),
        F.when(lost, PROTECTED),
        F.when(~fits, STATUS),
    ))
    columns = {f"{side}_label": label, f"{side}_term": term, f"{side}_method": method, f"{side}_status": status, f"{side}_why": why, f"{side}_ready": has_han(label) & term.isNotNull() & ~lost & fits}
    return met.select(*rows.columns, *(v.alias(n) for n, v in columns.items()))


def described(rows: DataFrame, hits: DataFrame, terms: DataFrame, eligible: tuple[str, ...], relation_labels: dict[str, str], protected: str | None = None) -> DataFrame:
    """Validated candidates with fault_ids (and rules, where the hits are by rule), labels of both ends, whether they may be shown, and their ids: the last steps of the validation plan."""
    both = labelled_side(labelled_side(rows, "head", terms, eligible, protected), "tail", terms, eligible, protected)
    names = F.create_map(*(F.lit(x) for pair in relation_labels.items() for x in pair)) if relation_labels else F.create_map().cast("map<string,string>")
    classes = fault_classes(hits)
    listed = {c: F.coalesce(c, F.array().cast("array<string>")) for c in classes.columns[1:]}
    told = both.join(classes.hint("merge"), "candidate_id", "left").withColumns(listed | {"relation_label": F.try_element_at(names, F.col("relation"))})
    why = F.array_distinct(F.concat("head_why", "tail_why", F.when(F.col("relation_label").isNull(), F.array(F.lit("relation_zh_label_missing"))).otherwise(F.array().cast("array<string>"))))
    ids = {f"{s}_entity_id": stable_id("ENT", F.col(f"{s}_type"), F.coalesce(F.col(f"{s}_term"), normalised(F.col(s)))) for s in ("head", "tail")}
    out = told.withColumn("label_reasons", why).withColumn("ready", F.col("head_ready") & F.col("tail_ready") & F.col("relation_label").isNotNull()).withColumns(ids)
    return out.withColumn("claim_id", stable_id("CLAIM", F.col("head_entity_id"), F.col("relation"), F.col("tail_entity_id"))).drop("head_why", "tail_why")

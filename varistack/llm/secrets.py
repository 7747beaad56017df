"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query over lower-case trigrams is derived that every match implies.
The index holds postings (trigram, document) of the trigrams that some query names; grouping the
postings of a document and testing the queries on the trigrams found intersects them. Only the
candidates' texts are then matched with the rule. A rule without a mandatory trigram scans every text.

Positions come from the pieces that lie between the matches: a match begins after all pieces and
matches before it. They count code points; ends are exclusive.
"""

from __future__ import annotations

from functools import reduce
from re import _constants as C
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varistack.llm.common import table


class Rule(NamedTuple):
    kind: str
    regex: str
    #: A match counts if this group of it has at least ``least`` characters.
    group: int = 0
    least: int = 1


#: The base rules, then further well-known key formats; spans that start together come in this order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
_MASK_BITS = 60
ALL = ("all",)


def _together(kind: str, parts: list) -> tuple | str:
    parts = list(dict.fromkeys(p for p in parts if not (kind == "all" and p == ALL)))
    if kind == "any" and ALL in parts:
        return ALL
    return parts[0] if len(parts) == 1 else (kind, *parts)


def _finite(op, arg) -> set[str] | None:
    """All strings that a regex element matches, lower-cased, if they are few."""
    out: set[str] | None = None
    if op is C.LITERAL:
        out = {chr(arg).lower()}
    elif op is C.AT:
        out = {""}
    elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
        out = {chr(a).lower() for _, a in arg}
    elif op is C.SUBPATTERN:
        out = _product([_finite(*x) for x in arg[-1]])
    elif op is C.BRANCH:
        each = [_product([_finite(*x) for x in branch]) for branch in arg[1]]
        out = None if None in each else set().union(*each)
    elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2:
        each = [_product([_finite(*x) for x in arg[2]] * n) for n in range(arg[0], arg[1] + 1)]
        out = None if None in each else set().union(*each)
    return out if out is not None and len(out) <= 64 else None


def _product(sets: list) -> set[str] | None:
    out = {""}
    for own in sets:
        if own is None or len(out) * len(own) > 64:
            return None
        out = {a + b for a in out for b in own}
    return out


def _grams(strings: set[str]) -> tuple | str:
    """Some string occurs: the trigrams of one of them all do."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [s for s in sets if not any(t < s for t in sets)]
    return _together("any", [_together("all", sorted(s)) for s in sorted(least, key=sorted)])


def trigram_query(regex: str) -> tuple | str:
    """A Boolean query that the lower-cased text of every match satisfies; ``ALL`` where there is none.

    A query is a trigram or ``("all" | "any", query, ...)``.
    """

    def derive(items) -> tuple | str:
        parts, run = [], {""}
        for op, arg in items:
            own = _finite(op, arg)
            if own is not None and len(own) * len(run) <= 64:
                run = {a + b for a in run for b in own}
                continue
            parts.append(_grams(run))
            run = own or {""}
            if own is None:
                if op is C.SUBPATTERN:
                    parts.append(derive(arg[-1]))
                elif op is C.BRANCH:
                    parts.append(_together("any", [derive(b) for b in arg[1]]))
                elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                    parts.append(derive(arg[2]))
        return _together("all", [*parts, _grams(run)])

    return derive(_parser.parse(regex))


def _trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1:])) if len(query) > 1 else set()


def _holds(query, has) -> Column:
    if isinstance(query, str):
        return has(query)
    return reduce(lambda a, b: a & b if query[0] == "all" else a | b, [_holds(q, has) for q in query[1:]])


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of ``(start, ord, end, kind)`` of the rule's leftmost non-overlapping matches that count."""
    if rule.kind in ("access", "hex"):  # a maximal run of one class: the least length can go into the regex
        prefix = len("AKIA") if rule.kind == "access" else 0
        rule = rule._replace(regex=rule.regex[:-1] + "{%d,}" % (rule.least - prefix), least=1)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(F.transform(F.split(text, rule.regex, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(counted, F.length).alias("own"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.regex), found).otherwise(start["out"])


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``(gram, doc_id, h)`` for each of the trigrams that a lower-cased text holds."""
    lowered = keyed.select("doc_id", "h", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return lowered.select(F.explode(held).alias("gram"), "doc_id", "h")


def _found(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """``(f_id, f_h, spans)`` of each id and text hash that has spans."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    queries = {i: trigram_query(r.regex) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q != ALL}
    names = sorted(set().union(set(), *map(_trigrams, indexed.values())))
    place = {t: i for i, t in enumerate(names)}
    none = _no_spans()
    full = [_spans(F.col("text"), rules[i], i) for i, q in queries.items() if q == ALL]
    parts = []
    if full:
        parts.append(keyed.select("doc_id", "h", F.concat(*full).alias("spans")).where(F.size("spans") > 0))
    if indexed:
        masks = [
            F.bit_or(F.when(F.floor(F.col("gram") / _MASK_BITS) == m, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("gram") % _MASK_BITS).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{m}")
            for m in range(-(-len(names) // _MASK_BITS))
        ]

        def has(gram: str) -> Column:
            return F.col(f"m{place[gram] // _MASK_BITS}").bitwiseAND(F.lit(1 << place[gram] % _MASK_BITS)) != 0

        grouped = postings(keyed, names).groupBy("doc_id", "h").agg(*masks)
        tests = [F.when(_holds(q, has), F.lit(i)) for i, q in indexed.items()]
        wanted = grouped.select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), F.array_compact(F.array(*tests)).alias("rules")).where(F.size("rules") > 0)
        texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")))
        verified = [F.when(F.array_contains("rules", i), _spans(F.col("text"), rules[i], i)).otherwise(none) for i in indexed]
        parts.append(texts.select("doc_id", "h", F.concat(*verified).alias("spans")).where(F.size("spans") > 0))
    found = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return found.select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), "spans")


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans)`` per row: spans by start, then rule, as structs ``(start, ord, end, kind)``.

    A null text is empty and has no spans. Null ids and repeated rows are kept, each with its spans;
    rows of one id with different texts are told apart by a hash of the text.
    """
    found = _found(docs, rules, id_col, text_col)
    rows = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__h"))
    out = rows.join(found, F.col(id_col).eqNullSafe(F.col("f_id")) & (F.col("__h") == F.col("f_h")), "left")
    return out.select(id_col, F.coalesce("spans", _no_spans()).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows, whole, with each maximal run of overlapping spans in the text replaced by ``mark``.

    A column ``size_col``, if there is one, gets the new length of a changed text. Null texts stay null.
    """
    found = _found(docs, rules, id_col, text_col).select(F.col("f_id").alias("__id"), F.col("f_h").alias("__fh"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = rows.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__fh")), "left")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        apart = F.concat(acc["out"], F.substring(text, acc["at"] + 1, span["start"] - acc["at"]), F.lit(mark))
        new = (span["start"] >= acc["at"]) & ((span["start"] > acc["at"]) | (acc["out"] == ""))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(new, apart).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = F.col("__spans").isNotNull()
    cleaned = joined.withColumn("__clean", F.when(changed, clean).otherwise(text))
    # the length is taken of the finished column: inside one projection with the fold above it comes out wrong
    columns = {c: F.col(c) for c in docs.columns} | {text_col: F.col("__clean")}
    if size_col in docs.columns:
        columns[size_col] = F.when(changed, F.length("__clean").cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col))
    return cleaned.select(*[value.alias(name) for name, value in columns.items()])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    counts = [F.size(F.filter("spans", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _oracle() -> str:
    """The same spans in DuckDB: pieces and matches of each rule, and running sums of their lengths."""
    arms = []
    for order, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        arms.append(
            f"""SELECT doc_id, {order} AS ord, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, p FROM (
            SELECT doc_id, regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {r.group}) AS g, regexp_split_to_array(text, '{regex}') AS p FROM docs
            WHERE regexp_matches(text, '{regex}'))"""
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    raw AS ({" UNION ALL ".join(arms)}),
    sized AS (SELECT doc_id, ord, kind, i, length(g[i]) AS own, length(p[i]) AS gap, length(m[i]) AS size FROM raw),
    placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM sized),
    spans AS (SELECT doc_id, ord, kind, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE own >= CASE ord {least} END),
    told AS (SELECT doc_id, {counts},
      coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}), '') AS base,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN told USING (doc_id)"""


ORACLE = _oracle()

"""Secret scans with multipart credential linking.

Base patterns find secrets that stand on their own.  Beside them the scan collects weak parts: account
identifiers, random-looking strings and endpoints, each of which alone is common in clean text.  An interval
join brings together the parts of a text that lie within a scope of each other, and a weak part is reported
only where the parts that complete it co-occur.

Positions are counted in code points.  A pattern's matches and the pieces between them come from one split
and one extraction in the JVM; running sums of their lengths give the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import prepare, quoted, written

# The kinds in the order in which spans that start together are listed, with their patterns.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "weak_id": r"""(?i)\b(?:client|account|user|access|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""",
    "weak_secret": r"[A-Za-z0-9+/=_-]{20,}",
    "endpoint": r"""(?i)\b(?:https?|wss?|s3|jdbc:[a-z]+|amqps?|rediss?|mysql|postgres(?:ql)?|mongodb(?:\+srv)?)://[^\s"'<>]+""",
}
SPAN = "array<struct<s:int,k:int,e:int>>"
RUN = 256


def _gathered(array: str, zero: str, step: str, emit: str, value: str, last: str) -> Column:
    """Spans that a pass over array emits, in order.

    st is the state so far and x the element: step is the state after it, value what it emits where emit holds,
    last the spans that the final state adds.  Spark copies what a pass has gathered at every step, so that one
    pass over n elements would cost n * n; they are taken in about sqrt(n) runs of sqrt(n), each gathered apart.
    """
    none = f"cast(array() as {SPAN})"
    within = lambda sql: sql.replace("st.", "o.st.")
    length = f"greatest({RUN}, cast(ceil(sqrt(size(z))) as int))"
    run = f"""aggregate(c, named_struct('st', acc.st, 'run', {none}),
        (o, x) -> named_struct('st', {within(step)}, 'run', if({within(emit)}, concat(o.run, array({within(value)})), o.run)))"""
    return F.expr(f"""
        aggregate(array({array}), {none}, (whole, z) -> case when size(z) > 0 then
          aggregate(transform(sequence(0, (size(z) - 1) div {length}), i -> slice(z, cast(i * {length} + 1 as int), {length})),
            named_struct('st', {zero}, 'out', {none}),
            (acc, c) -> aggregate(array({run}), named_struct('st', {zero}, 'out', {none}), (same, r) -> named_struct('st', r.st, 'out', concat(acc.out, r.run))),
            acc -> concat(acc.out, {last.replace("st.", "acc.st.")})) else {none} end)""")  # fmt: skip


def _spans(matches: str, pieces: str, k: int, keep: str = "true") -> Column:
    """Spans of one kind from its matches and the pieces between them, in order; keep is SQL on the match m."""
    each = f"zip_with({matches}, slice({pieces}, 1, size({matches})), (m, p) -> named_struct('a', length(p), 'b', length(m), 'keep', {keep}))"
    here = f"named_struct('s', st.at + x.a, 'k', {k}, 'e', st.at + x.a + x.b)"
    return _gathered(each, "named_struct('at', 0)", "named_struct('at', st.at + x.a + x.b)", "x.keep", here, f"cast(array() as {SPAN})")


def _apart(spans: str, others: str) -> Column:
    """The spans, in order and apart from each other, that overlap none of others: one pass over both by start.

    A span is held until the next one begins; any other that begins meanwhile and before its end drops it.
    """
    one, event = SPAN.removeprefix("array<").removesuffix(">"), "transform({}, b -> named_struct('s', b.s, 'o', {}, 'k', b.k, 'e', b.e))"
    held = "case when x.o = 0 then if(x.s < st.held.e, null, st.held) when st.top <= x.s then named_struct('s', x.s, 'k', x.k, 'e', x.e) end"
    left = _gathered(
        f"array_sort(concat({event.format(others, 0)}, {event.format(spans, 1)}))",
        f"named_struct('top', -1, 'held', cast(null as {one}))",
        f"named_struct('top', if(x.o = 0, greatest(st.top, x.e), st.top), 'held', {held})",
        "x.o = 1 and st.held is not null",
        "st.held",
        f"if(st.held is null, cast(array() as {SPAN}), array(st.held))",
    )
    return F.when(F.expr(f"size({spans}) = 0 or size({others}) = 0"), F.col(spans)).otherwise(left)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x.k + 1), x.s.cast("string"), x.e.cast("string")))
    return F.array_join(text, ",")


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, base, weak): spans of every row; h tells the texts of one id apart."""
    t = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    none = F.lit(None).cast("array<string>")
    found = []
    for i, k in enumerate(KINDS):
        hit = F.col("text").rlike(PATTERNS[k])
        found.append(F.when(hit, F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"m{i}"))
        found.append(F.when(hit, F.split("text", PATTERNS[k], -1)).otherwise(none).alias(f"p{i}"))
    t = t.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), *found)
    group = PATTERNS["assign"].replace("\\", "\\\\").replace("'", "\\'")
    keep = {"assign": f"length(regexp_extract(m, '{group}', 2)) >= 8", "access": "length(m) >= 16", "weak_secret": "m rlike '[0-9]' and m rlike '[A-Z]' and m rlike '[a-z]'"}
    empty = F.expr(f"cast(array() as {SPAN})")
    each = [F.coalesce(_spans(f"m{i}", f"p{i}", i, keep.get(k, "true")), empty).alias(f"s{i}") for i, k in enumerate(KINDS)]
    t = t.select("doc_id", "h", *each).select("doc_id", "h", F.concat("s0", "s1", "s2").alias("base"), "s3", "s4", "s5")
    t = t.withColumn("strong", F.concat("base", "s3", "s5"))
    return t.select("doc_id", "h", "base", F.concat("s3", _apart("s4", "strong"), "s5").alias("weak"))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """(doc_id, h, spans): the weak spans whose complement lies within scope of them."""
    some = parts.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).distinct()
    role = F.expr("case when k in (1, 3) then 'id' when k in (0, 2, 4) then 'secret' else 'endpoint' end")
    weak = some.select("doc_id", "h", F.explode("weak").alias("x")).select("doc_id", "h", "x.*")
    weak = weak.withColumn("bin", F.explode(F.expr(f"sequence(greatest(0, s - {scope}) div {scope}, (e + {scope}) div {scope})")))
    every = some.select("doc_id", "h", F.explode(F.concat("base", "weak")).alias("x")).select("doc_id", "h", "x.*", )
    every = every.select("doc_id", "h", role.alias("role"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.explode(F.expr(f"sequence(s div {scope}, e div {scope})")).alias("bin"))
    near = weak.alias("w").join(every.alias("o"), F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.h") == F.col("o.h")) & (F.col("w.bin") == F.col("o.bin")) & (F.greatest(F.col("s") - F.col("e2"), F.col("s2") - F.col("e")) <= scope))
    has = {r: F.bool_or(F.col("role") == r).alias(r) for r in ("id", "secret", "endpoint")}
    near = near.groupBy("w.doc_id", "w.h", "k", "s", "e").agg(*has.values())
    near = near.where("case k when 3 then secret when 4 then id or endpoint else id and secret end")
    return near.groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "k", "e")).alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """All spans of secrets in every whole text.

    Returns one row per row of docs: ``id_col``, base and linked, arrays of (s, k, e): start and end in code
    points, k the kind's place in KINDS.  Base spans are the leftmost non-overlapping matches of each kind,
    failing ones dropped; linked are weak parts whose complement lies within scope code points: an identifier
    needs a secret, a secret an identifier or an endpoint, an endpoint both.  A null text is empty and has no
    spans; rows that repeat id and text have equal results; an empty table gives no rows; other columns are
    not read.  Parts meet by text and interval bin, so what is joined in one place is bounded by the scope.
    """
    prepare(docs.sparkSession)
    parts = written(_parts(docs, id_col, text_col), "secret-parts")
    linked = _linked(parts, scope)
    out = parts.alias("p").join(linked.alias("l"), F.col("p.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("p.h") == F.col("l.h")), "left")
    return out.select(F.col("p.doc_id").alias(id_col), "base", F.coalesce("linked", F.expr(f"cast(array() as {SPAN})")).alias("linked"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Counts and listed spans: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = find_secrets(docs, id_col, text_col, scope)
    n = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    return found.select(id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))

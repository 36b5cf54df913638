"""Personal data: spans by pattern, and terms that reveal them as corpus co-occurrence estimates it. Spark SQL only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.common import documents
from latticework.session import Scratch, likely, ship, spare, split_by

LOCAL = "[A-Za-z0-9._%+-]"
#: Kind, what a text must have to be looked at, and the pattern. They match what the plain forms of the kinds match,
#: leftmost and longest, but never go back: an e-mail address begins where a run of its characters does or the last
#: address ended, a number at its first digit, and a card number has 14 digits at least.
KINDS = [
    ("email", "contains(text, '@')", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "text rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", "text rlike '[0-9]'", r"[0-9](?:[\x20-]?[0-9]){13,}+"),
    ("phone", "contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
#: Whether a match counts.
DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = f"""aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + cast(substring(reverse({DIGITS}), i, 1) as int) * if(i % 2 = 0, 2, 1)
    - if(i % 2 = 0 and cast(substring(reverse({DIGITS}), i, 1) as int) > 4, 9, 0)) % 10 = 0"""
VALID = {
    "email": "true",
    "ip": r"forall(split(m, '[.]'), x -> length(trim(leading '0' from x)) <= 3 and coalesce(try_cast(trim(leading '0' from x) as int), 0) <= 255)",
    "card": f"if(length({DIGITS}) between 14 and 19, {LUHN}, false)",
    "phone": f"length({DIGITS}) between 10 and 15",
}
#: Terms are runs of letters, of any length, in small letters; 64-bit hashes stand for them and for values.
TERMS = r"array_distinct(transform(filter(array_distinct(split(text, '[^\\p{L}]+')), x -> x <> ''), x -> xxhash64(lower(x))))"
#: Where a run of letters begins or ends.
EDGE = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"
VALUES = "array_distinct(transform(spans, x -> concat(x.kind, ':', lower(x.m))))"
#: What a value has in common with others: its kind, and the domain of an address or the first digits of a number.
DIGITS_OF = "regexp_replace(x.m, '[^0-9]', '')"
COMMON = f"""transform(spans, x -> concat(x.kind, '*', case x.kind when 'email' then substring_index(lower(x.m), '@', -1) when 'ip' then substring_index(x.m, '.', 2) when 'card' then substring({DIGITS_OF}, 1, 4) else substring({DIGITS_OF}, 1, 3) end))"""
CLASSES = f"array_distinct(concat({VALUES}, {COMMON}, transform(spans, x -> concat(x.kind, '*'))))"
SAME = "l.doc_id <=> r.doc_id and l.tag = r.tag"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(items: str, kind: str, start: str, step: str) -> str:
    """SQL: struct at, out of a fold over an array: at from start on, out of structs `kind`; step is the struct that follows from (a, x).

    Appending to an array copies it, so the fold goes in about sqrt(n) parts of sqrt(n) items each, whose outs are
    then put together.
    """
    none, wide = f"cast(array() as array<{kind}>)", f"greatest(cast(sqrt(size({items})) as int), 1)"
    part = f"aggregate(slice({items}, c * {wide} + 1, {wide}), named_struct('at', b.at, 'out', {none}), (a, x) -> {step})"
    joined = f"element_at(transform(array({part}), p -> named_struct('at', p.at, 'out', concat(b.out, p.out))), 1)"
    whole = f"aggregate(sequence(0, cast((size({items}) - 1) / {wide} as int)), named_struct('at', {start}, 'out', {none}), (b, c) -> {joined})"
    return f"if(size({items}) > 0, {whole}, named_struct('at', {start}, 'out', {none}))"


def _matches(text: str, pattern: str) -> str:
    """SQL: array of (m, s, e) of a pattern's matches, places in code points: what lies between them adds up."""
    q, kind = _quoted(pattern), "struct<m: string, s: int, e: int>"
    begin, end = "a.at + x.gap", "a.at + x.gap + length(x.m)"
    step = f"named_struct('at', {end}, 'out', array_append(a.out, named_struct('m', x.m, 's', {begin}, 'e', {end})))"
    both = f"zip_with(slice(split({text}, {q}), 1, size(f)), f, (t, m) -> named_struct('gap', length(t), 'm', m))"
    return f"element_at(transform(array(regexp_extract_all({text}, {q}, 0)), f -> element_at(transform(array({both}), z -> ({_folded('z', kind, '0', step)}).out), 1)), 1)"


def _base(k: int) -> Column:
    """The valid spans of kind k: array of (s, k, e, kind, m)."""
    kind, look, pattern = KINDS[k]
    found = f"filter({_matches('text', pattern)}, y -> element_at(transform(array(y.m), m -> {VALID[kind]}), 1))"
    return F.expr(f"if({look}, transform({found}, y -> named_struct('s', y.s, 'k', {k}, 'e', y.e, 'kind', '{kind}', 'm', y.m)), cast(array() as array<struct<s: int, k: int, e: int, kind: string, m: string>>))")


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), spans (in order of start, then kind) and text, null where there are no spans. Null texts count as empty."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = src.select("doc_id", "text", F.xxhash64("text").alias("tag"), *(_base(k).alias(kind) for k, (kind, _, _) in enumerate(KINDS)))
    return each.select("doc_id", "tag", "text", F.expr("array_sort(concat(email, ip, card, phone))").alias("spans")).withColumn("text", F.expr("if(size(spans) > 0, text, null)"))


def revealing_terms(docs: DataFrame, found: DataFrame, scratch: Scratch, least_share: float, least_documents: int, classes: bool) -> DataFrame:
    """doc_id, tag and terms (array of s, e): every place of the words of a text that tell too much about one of its values, outside its spans.

    For a protected value e and a term t, over documents: the term's pointwise information about the value,
    log(N * n(e, t) / (n(e) * n(t))), as a share of the value's own information log(N / n(e)), is 1 if the term is
    found with that value only. Terms with least_share or more are revealing, if n(e, t) >= least_documents. N, n(e),
    n(t) and n(e, t) are counted over the whole texts of all of docs, a row each. A share of least_share needs
    n(t) <= n(e) * (N / n(e)) ^ (1 - least_share), as n(e, t) <= n(e); other pairs are not formed. With classes the
    kind of a value, and its domain or first digits, are protected as well, like a value: they recur where values don't.
    """
    of = F.expr(f"transform({CLASSES if classes else VALUES}, v -> xxhash64(v))")
    key = ["doc_id", "tag"]
    some = found.where("size(spans) > 0")
    total = docs.agg(F.count("*").alias("n_all"))
    values = some.select(F.explode(of).alias("value")).groupBy("value").agg(F.count("*").alias("n_value")).where(F.col("n_value") >= least_documents)
    values = values.crossJoin(F.broadcast(total)).where("n_value < n_all")
    most = F.col("n_value") * F.pow(F.col("n_all") / F.col("n_value"), F.lit(1 - least_share)) * (1 + 1e-9)
    values = scratch.table(values.withColumn("most", most), "values")
    own = some.select(*key, F.explode(of).alias("value"))
    held = scratch.table(likely(own, values, ["value"]).join(values, "value").dropDuplicates([*key, "value"]), "held")
    terms = docs.where("text is not null").select(F.explode(F.expr(TERMS)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    terms = terms.crossJoin(F.broadcast(values.agg(F.max("most").alias("top")))).where((F.col("n_term") >= least_documents) & (F.col("n_term") <= F.col("top")))
    words = likely(some, held, key).select(*key, F.explode(F.expr(TERMS)).alias("term")).join(terms.drop("top"), "term")
    near = words.alias("l").join(held.alias("r"), F.expr(f"{SAME} and l.n_term <= r.most")).select("l.doc_id", "l.tag", "value", "term", "n_value", "n_term", "n_all")
    near = scratch.table(near, "near")
    pairs = near.groupBy("value", "term", "n_value", "n_term", "n_all").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least_documents)
    share = F.log(F.col("n_all") * F.col("n_both") / (F.col("n_value") * F.col("n_term"))) / F.log(F.col("n_all") / F.col("n_value"))
    told = scratch.table(pairs.where(share >= least_share).select("value", "term"), "told")
    marked = scratch.table(likely(near, told, ["value", "term"]).join(told, ["value", "term"]).select(*key, "term").distinct(), "marked")
    texts = likely(some, marked, key).select(*key, "text").dropDuplicates(key)
    texts = texts.alias("l").join(marked.select(*key).distinct().alias("r"), F.expr(SAME), "left_semi")
    parts = texts.select(*key, F.posexplode(F.split("text", EDGE)).alias("k", "part"))
    parts = parts.withColumn("e", F.sum(F.length("part")).over(Window.partitionBy(*key).orderBy("k")).cast("int"))
    places = parts.where(F.col("part").rlike(r"^\p{L}")).select(*key, F.xxhash64(F.lower("part")).alias("term"), (F.col("e") - F.length("part")).alias("s"), "e")
    hits = places.alias("l").join(marked.alias("r"), F.expr(f"{SAME} and l.term = r.term"), "left_semi")
    # a term overlaps a span if the furthest end of the spans that begin before its end is beyond its start
    spans = likely(some, marked, key).select(*key, "spans").dropDuplicates(key).select(*key, F.explode("spans").alias("x"))
    both = hits.select(*key, F.expr("2 * e - 1").alias("k"), "s", "e", F.lit(None).cast("int").alias("reach")).unionByName(spans.select(*key, F.expr("2 * x.s").alias("k"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.col("x.e").alias("reach")))
    both = both.withColumn("reach", F.max("reach").over(Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    free = both.where("s is not null and (reach is null or reach <= s)")
    return free.groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("terms"))


def all_spans(docs: DataFrame, scratch: Scratch, least_share: float, least_documents: int, classes: bool) -> DataFrame:
    """doc_id, tag, spans (of the patterns) and every (these and terms, in order) of each row of docs."""
    found = scratch.table(base_spans(docs), "found")
    terms = revealing_terms(docs, found, scratch, least_share, least_documents, classes)
    some = found.where("size(spans) > 0").alias("f").join(terms.alias("t"), F.expr("f.doc_id <=> t.doc_id and f.tag = t.tag"), "left").select("f.doc_id", "f.tag", "f.spans", "t.terms")
    every = F.expr(f"array_sort(concat(spans, coalesce(transform(terms, x -> named_struct('s', x.s, 'k', {len(KINDS)}, 'e', x.e, 'kind', 'term', 'm', '')), cast(array() as array<struct<s: int, k: int, e: int, kind: string, m: string>>))))")
    return some.withColumn("every", every).drop("terms").unionByName(found.where("size(spans) = 0").select("doc_id", "tag", "spans", F.col("spans").alias("every")))


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def pii_spans(docs: DataFrame, least_share: float = 0.95, least_documents: int = 3, id_col: str = "doc_id", text_col: str = "text", classes: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of docs.

    base_sha256 is of the pattern spans as kind:start:end, comma-joined; spans lists these and the terms that reveal
    a value (kind term), as revealing_terms says; with classes also those that reveal its kind, domain or first digits. Null and empty texts have no spans. Null and repeated ids stay, a
    row each: rows equal in id and text get one result; the same text under two ids counts as two documents. An
    empty table gives an empty table; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = all_spans(documents(docs, id_col, text_col), scratch, least_share, least_documents, classes)
    counts = [F.expr(f"cast(size(filter(spans, x -> x.k = {k})) as long)").alias(f"n_{kind}") for k, (kind, _, _) in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.expr(_listed("spans")), 256).alias("base_sha256"), F.expr(_listed("every")).alias("spans"))


def sanitise(docs: DataFrame, least_share: float = 0.95, least_documents: int = 3, id_col: str = "doc_id", text_col: str = "text", classes: bool = False) -> DataFrame:
    """docs with the spans in its texts generalised to their kind in brackets, such as [EMAIL] or [TERM].

    Spans that overlap become one, of the first one's kind. All columns stay as they are but for the text; null texts
    stay null.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "sanitise")
    own, (number, tag, every, gaps) = docs.columns, spare(docs, "_id", "_tag", "_every", "_gaps")
    found = all_spans(documents(docs, id_col, text_col), scratch, least_share, least_documents, classes).where("size(every) > 0")
    found = scratch.table(found.select(F.col("doc_id").alias(number), F.col("tag").alias(tag), F.col("every").alias(every)).dropDuplicates([number, tag]), "spans")
    placed = docs.withColumns({number: F.col(id_col), tag: F.xxhash64(F.coalesce(text_col, F.lit("")))})
    calm, near = split_by(placed, found, [number, tag])
    hit = near.alias("d").join(found.alias("f"), F.expr(f"d.{number} <=> f.{number} and d.{tag} = f.{tag}"), "left").select(*(F.col(f"d.`{c}`") for c in own), f"f.{every}")
    # at: the furthest end so far; out: where each group of overlapping spans begins, what ended before it, and its kind
    step = "if(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out), named_struct('at', x.e, 'out', array_append(a.out, named_struct('before', a.at, 's', x.s, 'kind', x.kind))))"
    hit = hit.withColumn(gaps, F.expr(f"if({every} is null, null, {_folded(every, 'struct<before: int, s: int, kind: string>', '0', step)})"))
    # substring() counts from the text's beginning, so pieces are cut from parts of the text and not from the whole
    text, wide = f"`{text_col}`", f"greatest(cast(sqrt(size({gaps}.out)) as int), 1)"
    piece = "concat(substring(p.t, x.before - p.at + 1, x.s - x.before), '[', upper(x.kind), ']')"
    part = f"element_at(transform(array(slice({gaps}.out, c * {wide} + 1, {wide})), m -> named_struct('m', m, 'at', m[0].before, 't', substring({text}, m[0].before + 1, element_at(m, -1).s - m[0].before))), 1)"
    cut = f"concat(array_join(transform(sequence(0, cast((size({gaps}.out) - 1) / {wide} as int)), c -> element_at(transform(array({part}), p -> array_join(transform(p.m, x -> {piece}), '')), 1)), ''), substring({text}, {gaps}.at + 1))"
    return calm.select(*own).unionByName(hit.withColumn(text_col, F.expr(f"if({gaps} is null, {text}, {cut})")).select(*own))

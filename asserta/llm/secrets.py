"""Secret scans: fixed patterns, and a battery of randomness tests over encoded-looking tokens. Spark expressions only.

Pattern spans: ``assign``, ``access`` and ``hex``, leftmost and non-overlapping within a kind.

Battery (kind ``random``): a candidate is a longest run of CANDIDATE's characters, 20 or more. Its encoding is the
smallest listed alphabet, of k signs, that holds all n of its characters. Three statistics are compared with those of
uniform, independent signs: chi-squared over the alphabet, the number of runs above and below the alphabet's middle,
and the correlation of each sign with the next; Fisher's method joins their p-values, and a candidate whose joint
p-value is under ALPHA isn't random. False discoveries are controlled against the opposite hypothesis, that a token is
text-like: by the number of equal pairs of signs, whose expected share in text is the alphabet's `text` and whose
spread falls with n, so a short token can't get a small p-value by chance alone. Within a document, the p-values,
weighted by n over the mean n, go through the step-up rule of Benjamini and Hochberg at level Q.

Offsets count code points; ends are exclusive. Edge cases: a null text is an empty one and has no spans. Rows are
independent, so null or repeated ids, ties and extra columns change nothing; matches that begin at the same place are
listed as assign, access, hex, random. Work per text is linear but for the positions of many matches, which are summed
in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asserta.llm._expr import let, pieces, running, stretch

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the pattern's `+` with 18 characters or more: a shorter match ends where no other can begin
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ALPHA, Q = 0.001, 0.01
KINDS = ("assign", "access", "hex", "random")
#: Encodings by rising size; signs in order, and the share of equal pairs in text written with them.
ENCODINGS = (
    ("^[0-9]+$", "0123456789", 0.17),
    ("^[0-9a-f]+$", "0123456789abcdef", 0.12),
    ("^[0-9A-F]+$", "0123456789ABCDEF", 0.12),
    ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.066),
    ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.066),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.062),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.06),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.06),
    ("^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.055),
    ("^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.055),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 0.055),
)


NONE = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern whose `group` has `least` characters: (start, rank of the kind, end, the group)."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))

    def built(x: Column) -> Column:
        ends = running(F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), x["m"], lambda g, m: g + F.length(m)))
        value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
        made = F.transform(F.arrays_zip(ends.alias("e"), x["m"].alias("m")), lambda y: F.struct((y["e"] - F.length(y["m"])).alias("start"), F.lit(rank).alias("rank"), y["e"].alias("end"), value(y["m"]).alias("value")))
        return F.filter(made, lambda y: F.length(y["value"]) >= least)

    found = let(F.struct(match.alias("m"), gaps.alias("g")), built)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(NONE)).cast(NONE)


def upper_tail(z: Column) -> Column:
    """P(N > z) of the normal distribution, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.greatest(F.exp(-z * z / 2) * 0.3989422804014327 * poly, F.lit(1e-300))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(token: Column) -> Column:
    """A token's n, p_random (joint, of uniform independent signs) and p_text (of text-like signs)."""
    chosen = F.lit(None)
    for regex, signs, share in reversed(ENCODINGS):
        own = F.struct(F.lit(signs).alias("signs"), F.lit(share).alias("text"))
        chosen = F.when(token.rlike(regex), own).otherwise(chosen) if regex else own

    def sums(x: Column) -> Column:
        chars = F.filter(F.split(x["w"], ""), lambda c: c != "")
        kinds = F.transform(F.array_distinct(chars), lambda c: (F.length(x["w"]) - F.length(F.replace(x["w"], c, F.lit("")))).cast("double"))
        return F.struct(
            F.length(x["w"]).cast("double").alias("n"),
            F.length(x["e"]["signs"]).cast("double").alias("k"),
            x["e"]["text"].alias("text"),
            F.aggregate(kinds, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
            F.transform(chars, lambda c: F.instr(x["e"]["signs"], c).cast("double") - (F.length(x["e"]["signs"]) + 1) / 2).alias("s"),
        )

    def tests(x: Column) -> Column:
        n, k, s = x["n"], x["k"], x["s"]
        pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = F.size(F.filter(s, lambda a: a > 0)).cast("double")
        turns = F.size(F.filter(pairs, lambda p: (p["a"] > 0) != (p["b"] > 0))).cast("double")
        expected = 2 * high * (n - high) / n
        spread = expected * (expected - 1) / (n - 1)
        z_chi = (k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        z_runs = F.when(spread > 0, (turns - expected) / F.sqrt(spread)).otherwise(F.lit(40.0))
        variance = (k * k - 1) / 12
        z_serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["a"] * p["b"]) / (variance * F.sqrt(n - 1))
        fisher = -(F.ln(upper_tail(z_chi)) + F.ln(2 * upper_tail(F.abs(z_runs))) + F.ln(2 * upper_tail(F.abs(z_serial))))
        all_pairs = n * (n - 1) / 2
        equal = (x["squares"] - n) / 2
        z_text = (all_pairs * x["text"] - equal) / F.sqrt(all_pairs * x["text"])
        return F.struct(n.alias("n"), (F.exp(-fisher) * (1 + fisher + fisher * fisher / 2)).alias("p_random"), upper_tail(z_text).alias("p_text"))

    return let(let(F.struct(token.alias("w"), chosen.alias("e")), sums), tests)


def discovered(candidates: Column) -> Column:
    """Those of the candidates' spans that the battery and the step-up rule leave."""

    def judged(all_: Column) -> Column:
        total = F.aggregate(all_, F.lit(0.0), lambda acc, y: acc + y["t"]["n"])
        weighted = F.transform(all_, lambda y: F.struct(y["c"].alias("c"), (y["t"]["p_text"] * total / (y["t"]["n"] * F.size(all_))).alias("p"), y["t"]["p_random"].alias("r")))

        def cut(w: Column) -> Column:
            ranked = F.array_sort(F.transform(w, lambda y: y["p"]))
            passing = F.filter(F.transform(ranked, lambda p, i: F.when(p <= (i + 1) * Q / F.size(w), p)), lambda p: p.isNotNull())
            line = F.coalesce(F.array_max(passing), F.lit(-1.0))
            return let(line, lambda m: F.transform(F.filter(w, lambda y: (y["p"] <= m) & (y["r"] >= ALPHA)), lambda y: y["c"]))

        return let(weighted, cut)

    tested = F.transform(candidates, lambda c: F.struct(c.alias("c"), battery(c["value"]).alias("t")))
    return F.when(F.size(candidates) > 0, let(tested, judged)).otherwise(F.array().cast(NONE))


def scan(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """docs (which has a column text) and an array of all spans by start, then kind: start, rank of the kind in KINDS, end."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(spans(text, ASSIGN, 0, 2, 12), spans(text, ACCESS, 1), spans(text, HEX, 2))
    found = F.array_sort(F.concat(base, discovered(spans(text, CANDIDATE, 3))))
    return docs.withColumn(name, F.transform(found, lambda x: F.struct(x["start"], x["rank"], x["end"])))


def told(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, counts of the fixed kinds, the digest of their spans, and all spans."""
    some = scan(docs.select(*[F.col(f"`{c}`") for c in keep], "text"), "found_spans")
    base = F.filter(F.col("found_spans"), lambda x: x["rank"] < 3)
    ranks = F.transform(F.col("found_spans"), lambda x: x["rank"])
    counts = [F.size(F.filter(ranks, lambda r: r == F.lit(i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
    return some.select(*[F.col(f"`{c}`") for c in keep], *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch that spans cover, together where they overlap or touch, replaced by `mark`. Texts
    without spans, null ones too, stay as they are."""

    def cover(x: Column) -> Column:
        before = F.transform(x["s"], lambda s, k: F.struct(F.coalesce(F.get(x["r"], k - 1), F.lit(0)).alias("from"), s["start"].alias("to")))
        opened = F.filter(before, lambda y, k: (k == 0) | (y["to"] > y["from"]))
        kept = F.array_join(F.transform(opened, lambda y: F.concat(stretch(x["p"], y["from"], y["to"]), F.lit(mark))), "")
        return F.concat(kept, stretch(x["p"], F.element_at(x["r"], -1), x["n"]))

    some = scan(docs, "found_spans__")
    reach = running(F.transform("found_spans__", lambda s: s["end"]), F.greatest)
    whole = F.struct(pieces(F.col("text")).alias("p"), F.length("text").cast("long").alias("n"), F.col("found_spans__").alias("s"), reach.alias("r"))
    text = F.when(F.size("found_spans__") > 0, let(whole, cover)).otherwise(F.col("text"))
    return some.withColumn("text", text).drop("found_spans__")


def _sql() -> str:
    """The report over `documents` in DuckDB. Its patterns have no look-behind: lengths are tested instead, which is
    the same for longest runs."""

    def tail(z: str) -> str:
        t = f"(1 / (1 + 0.2316419 * abs({z})))"
        poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
        one = f"greatest(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {poly}, 1e-300)"
        return f"(CASE WHEN ({z}) >= 0 THEN {one} ELSE 1 - {one} END)"

    cased = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = rf"""({cased})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = ((assign, 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16), ("[A-Za-z0-9+/_-]+", 0, 20))
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS k, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS g FROM docs)"
        for k, (p, g, _) in enumerate(kinds)
    )
    least = " ".join(f"WHEN {k} THEN {n}" for k, (_, _, n) in enumerate(kinds))
    signs = " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{s}'" for p, s, _ in ENCODINGS[:-1]) + f" ELSE '{ENCODINGS[-1][1]}'"
    shares = " ".join(f"WHEN regexp_matches(w, '{p}') THEN {x}" for p, _, x in ENCODINGS[:-1]) + f" ELSE {ENCODINGS[-1][2]}"
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), found AS ({found}),
spans AS (
    SELECT r, k, s, e, v FROM (SELECT r, k, v, e - length(m) AS s, e FROM (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS e FROM found))
    WHERE length(v) >= CASE k {least} END
), signed AS (
    SELECT r, s, e, w, length(w)::DOUBLE AS n, CASE {signs} END AS signs, (CASE {shares} END)::DOUBLE AS share FROM (SELECT r, s, e, v AS w FROM spans WHERE k = 3)
), ranked AS (
    SELECT *, length(signs)::DOUBLE AS kk, [instr(signs, c) - (length(signs) + 1) / 2.0::DOUBLE FOR c IN string_split(w, '') IF c <> ''] AS x,
        list_sum([((length(w) - length(replace(w, c, '')))::DOUBLE) ** 2 FOR c IN list_distinct(string_split(w, '')) IF c <> '']) AS squares FROM signed
), counted AS (
    SELECT *, len([y FOR y IN x IF y > 0])::DOUBLE AS high, len([j FOR j IN range(1, len(x)) IF (x[j] > 0) <> (x[j + 1] > 0)])::DOUBLE AS turns, list_sum([x[j] * x[j + 1] FOR j IN range(1, len(x))]) AS serial FROM ranked
), spread AS (SELECT *, 2 * high * (n - high) / n AS expected, (2 * high * (n - high) / n) * (2 * high * (n - high) / n - 1) / (n - 1) AS spread FROM counted),
z AS (
    SELECT r, s, e, n, (kk / n * squares - n - (kk - 1)) / sqrt(2 * (kk - 1) * (1 - 1 / n)) AS z1, abs(CASE WHEN spread > 0 THEN (turns - expected) / sqrt(spread) ELSE 40 END) AS z2,
        abs(serial / ((kk * kk - 1) / 12 * sqrt(n - 1))) AS z3, (n * (n - 1) / 2 * share - (squares - n) / 2) / sqrt(n * (n - 1) / 2 * share) AS z4 FROM spread
), p AS (SELECT r, s, e, n, -(ln({tail("z1")}) + ln(2 * {tail("z2")}) + ln(2 * {tail("z3")})) AS f, {tail("z4")} AS p FROM z),
weighted AS (SELECT r, s, e, exp(-f) * (1 + f + f * f / 2) AS random, p * sum(n) OVER (PARTITION BY r) / (n * count(*) OVER (PARTITION BY r)) AS p, count(*) OVER (PARTITION BY r) AS m FROM p),
placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p) AS place FROM weighted),
lined AS (SELECT *, coalesce(max(p) FILTER (p <= place * {Q} / m) OVER (PARTITION BY r), -1) AS line FROM placed),
kept AS (SELECT r, k, s, e FROM spans WHERE k < 3 UNION ALL SELECT r, 3, s, e FROM lined WHERE p <= line AND random >= {ALPHA}),
told AS (
    SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h, string_agg(said, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(said, ',' ORDER BY s, k, e) AS spans
    FROM (SELECT *, CASE k {names} END || ':' || s || ':' || e AS said FROM kept) GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (r)
"""


SQL = _sql()

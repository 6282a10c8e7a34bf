"""Rules, findings, scores and verdicts as array expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.prefilter import needed_sql, possible
from ..functions.text import base64_texts_sql, hidden_kinds_sql, let, lit, normalised, once, once_column, tag_text_sql

FINDING = "struct<rule: string, category: string, weight: int, description: string, evidence: string>"


#: A character of two UTF-16 units.
WIDE = r"[\x{10000}-\x{10FFFF}]"


def finding_sql(rule: str, evidence: str) -> str:
    category, weight, description = (V.EXTRA_FINDINGS.get(rule) or V.RULES[rule])[:3]
    return f"named_struct('rule', {lit(rule)}, 'category', {lit(category)}, 'weight', {weight}, 'description', {lit(description)}, 'evidence', {evidence})"


def snippet_sql(text: str, match: str, around: int) -> str:
    at = f"locate({match}, {text})"
    return f"concat('…', substring({text}, greatest({at} - {around}, 1), length({match}) + {around} + least({at} - 1, {around})), '…')"


#: All patterns of the rules, in order.
PATTERNS = [p for *_, patterns in V.RULES.values() for p in patterns]


def first_match_sql(text: str, patterns: list[str], flags: str = "(?U)", low: str | None = None, may: str | None = None) -> str:
    """What the first pattern that matches has matched; null if none does.

    A pattern is only run where the strings that its matches hold are there. low: the text with letters written as in the
    patterns, for flags without regard to case; may: the numbers in PATTERNS of those that can match, where they are known.
    """
    asked = lambda p: f"array_contains({may}, {PATTERNS.index(p)})" if may else needed_sql(low or text, p)
    return "coalesce(" + ", ".join(f"IF({asked(p)}, nullif(regexp_extract({text}, {lit(flags + p)}, 0), ''), NULL)" for p in patterns) + ")"


def rule_findings_sql(text: str, source: str = "''", may: str | None = None) -> str:
    """Findings of all rules over a normalised text, one at most for each rule, in the rules' order; may: see first_match_sql."""
    prefix = f"IF({source} = '', '', concat('[', {source}, '] '))"
    each = [let(first_match_sql(text, patterns, may=may), "m", f"IF(m IS NULL, NULL, {finding_sql(rule, f'concat({prefix}, {snippet_sql(text, 'm', 25)})')})") for rule, (_, _, _, patterns) in V.RULES.items()]
    return f"filter(array({', '.join(each)}), f -> f IS NOT NULL)"


def first_of_each_rule(findings: Column) -> Column:
    rules = F.transform(findings, lambda f: f["rule"])
    return F.filter(findings, lambda f, i: F.array_position(rules, f["rule"]) == i + 1)


def has(findings: Column, *categories: str) -> Column:
    return F.exists(findings, lambda f: f["category"].isin(*categories))


def prompt_findings(df: DataFrame, prompt: str, out: str = "findings", notes: str = "prompt_notes") -> DataFrame:
    """df with the findings and notes of a prompt column; a null prompt has none."""
    tag, kinds, blobs, texts, may = (f"__{out}_{x}" for x in ("tag", "kinds", "blobs", "texts", "may"))
    p = F.col(prompt)
    df = df.withColumns({tag: F.expr(once(tag_text_sql(prompt))), kinds: F.expr(once(hidden_kinds_sql(prompt))), blobs: F.expr(once(base64_texts_sql(prompt)))})
    df = df.withColumn(texts, once_column(normalised(F.concat(F.array(p, F.col(tag)), F.col(blobs)))))
    df = df.withColumn(may, possible(F.col(texts), PATTERNS))
    rules = lambda i, source="''": rule_findings_sql(f"element_at({texts}, {i})", source, f"element_at({may}, {i})")
    hidden = finding_sql("HID-001", f"concat(size({kinds}), ' hidden character(s): ', array_join(array_sort(array_distinct({kinds})), ', '))")
    encoded = f"flatten(transform({blobs}, (b, i) -> concat(array({finding_sql('ENC-001', "concat('decodes to: ', substring(b, 1, 120))")}), {rules('i + 3', lit('base64'))})))"
    found = f"concat(IF(size({kinds}) > 0, array({hidden}), array()), IF(trim({tag}) <> '', {rules(2, lit('hidden text'))}, array()), {rules(1)}, {encoded})"
    df = df.withColumn(out, F.expr(once(f"IF({prompt} IS NULL, CAST(array() AS array<{FINDING}>), {found})")))
    summary = has(F.col(out), "memory", "trust") & F.element_at(F.col(texts), 1).rlike("(?U)" + V.SUMMARY_REQUEST)
    shape = F.array(F.expr(finding_sql("SHP-001", "'summary request combined with memory/trust directives'")))
    df = df.withColumn(out, once_column(F.when(summary, F.concat(out, shape)).otherwise(F.col(out))))
    df = df.withColumn(out, once_column(first_of_each_rule(F.col(out))))
    urls = F.regexp_extract_all(p, F.lit(V.URL_IN_TEXT), F.lit(0))
    lines = F.array(
        F.when((F.size(kinds) > 0) & (F.trim(tag) != ""), F.concat(F.lit("Invisible tag characters spell out: "), tag)),
        F.when(F.size(urls) > 0, F.concat(F.lit("Links mentioned in the prompt: "), F.concat_ws(", ", F.transform(F.slice(urls, 1, 5), lambda u: F.substring(u, 1, 80))))),
        F.when(F.length(p) > 600, F.concat(F.lit("Unusually long prompt ("), F.length(p).cast("string"), F.lit(" characters) for a one-click link"))),
    )
    return df.withColumn(notes, F.array_compact(lines)).drop(tag, kinds, blobs, texts, may)


def total(findings: Column) -> Column:
    """Sum of weights without weak findings that a strong one covers, and what combinations add."""
    memory, trust, leak, override = (has(findings, c) for c in ("memory", "trust", "exfiltration", "override"))
    covered = lambda f: ((f["category"] == "memory-weak") & memory) | ((f["category"] == "trust-weak") & trust)
    base = F.aggregate(findings, F.lit(0), lambda s, f: s + F.when(covered(f), 0).otherwise(f["weight"]))
    return base + F.when(memory & trust, 3).otherwise(0) + F.when(leak, 3).otherwise(0) + F.when(override & (memory | trust | leak), 2).otherwise(0)


def verdict(findings: Column, score: Column) -> Column:
    return F.when(has(findings, "exfiltration") | (score >= 7), "DANGEROUS").when(score >= 4, "SUSPICIOUS").otherwise("LOOKS_SAFE")


def rank(verdict_: Column) -> Column:
    """0, 1, 2 by severity; null for other verdicts."""
    return F.when(verdict_ == "LOOKS_SAFE", 0).when(verdict_ == "SUSPICIOUS", 1).when(verdict_ == "DANGEROUS", 2)


def place_sql(low: str, patterns: list[str]) -> str:
    """Struct (start, end) of what the first pattern that matches has matched, in characters from 0; null if none does.

    Spark tells places in UTF-16 units, so for texts with characters of two units what stands before the match is taken and measured.
    """

    def one(pattern):
        plain, whole = lit("(?U)" + pattern), lit(rf"(?U)\A((?s:.)*?)(?:{pattern})")
        start = f"IF({low} RLIKE {lit(WIDE)}, char_length(regexp_extract({low}, {whole}, 1)), regexp_instr({low}, {plain}) - 1)"
        return let(f"regexp_extract({low}, {plain}, 0)", "m", f"IF(trim(m) = '', NULL, {let(start, 'a', "named_struct('start', a, 'end', a + char_length(m))")})")

    return f"coalesce({', '.join(map(one, patterns))})"


def highlight_sql(prompt: str, rules: str) -> str:
    """Array of (start, end, rules), in order: the stretches of a prompt, as written, in which its rules of strong categories
    have their first matches; stretches that touch are one. Characters count from 0, `end` is behind the last.

    rules: array of the ids that were found. Rules that only match the normalised prompt have no stretch, and a prompt whose
    length changes with lower-casing has none at all; a null prompt gives null.
    """
    strong = {rule: patterns for rule, (category, _, _, patterns) in V.RULES.items() if category in V.STRONG}
    entry = lambda rule, i, patterns: let(f"IF(array_contains({rules}, {lit(rule)}), {place_sql('low', patterns)}, NULL)", "p", f"IF(p IS NULL, NULL, named_struct('start', p.start, 'at', {i}, 'end', p.end, 'rules', array({lit(rule)})))")
    found = f"array_sort(array_compact(array({', '.join(entry(rule, i, patterns) for i, (rule, patterns) in enumerate(strong.items()))})))"
    stretch = "array<struct<start: int, end: int, rules: array<string>>>"
    last = "element_at(acc, -1)"
    joined = f"named_struct('start', {last}.start, 'end', greatest({last}.end, r.end), 'rules', concat({last}.rules, r.rules))"
    fold = f"aggregate({found}, CAST(array() AS {stretch}), (acc, r) -> IF(size(acc) > 0 AND r.start <= try_element_at(acc, -1).end, concat(slice(acc, 1, size(acc) - 1), array({joined.replace('element_at(acc', 'try_element_at(acc')})), array_append(acc, named_struct('start', r.start, 'end', r.end, 'rules', r.rules))))"
    marked = let(f"lower({prompt})", "low", f"IF(char_length(low) <> char_length({prompt}), CAST(array() AS {stretch}), {fold})")
    return f"IF({prompt} IS NULL, NULL, {marked})"


def plain_findings(findings: Column, wrapped: Column) -> Column:
    """Array of sentences on what a link tries to do, in a fixed order; wrapped: its wrapper links."""
    said = F.transform(findings, lambda f: F.array(f["category"], f["rule"]))
    names = F.coalesce(F.flatten(said), F.array().cast("array<string>"))
    lines = F.array_compact(F.array(*[F.when(F.array_contains(names, name), sentence) for name, sentence in V.PLAIN], F.when(F.size(wrapped) > 0, V.PLAIN_WRAPPED)))
    weak = F.arrays_overlap(names, F.array(F.lit("memory-weak"), F.lit("trust-weak")))
    return F.when((F.size(lines) == 0) & weak, F.array(F.lit(V.PLAIN_WEAK))).otherwise(lines)


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, c, w, d, p) for k, (c, w, d, p) in V.RULES.items()], "id string, category string, weight int, description string, patterns array<string>")

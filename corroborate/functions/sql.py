"""The normalisers and span functions under names that SQL can call.

``register`` creates them as temporary SQL functions of the session. Their bodies are expressions, which the
optimizer inlines: a query that calls them plans what the Column form plans. Names that begin with an
underscore are steps of the others: a parameter is a value computed once, whether or not the body needs it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corroborate.functions import normalize as N
from corroborate.functions.spans import CHUNK


def _words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _map(values: dict) -> str:
    return f"map({', '.join(f'{k!r}, {v!r}' for k, v in values.items())})"


def _group(pattern: str, k: int) -> str:
    return f"nullif(regexp_extract(t, r'{pattern}', {k}), '')"


_PAIRS = [x + y for x, y in N.LOOKALIKES] + [y + x for x, y in N.LOOKALIKES]
_PART = "STRUCT<y: STRING, m: STRING, d: STRING, kind: STRING>"
_SPAN = "ARRAY<STRUCT<value: STRING, start: INT, `end`: INT>>"
_DIFFERING = "filter(zip_with(split(a, ' '), split(b, ' '), (p, q) -> struct(p AS p, q AS q)), s -> NOT s.p <=> s.q)"
_RUN = "aggregate({lengths}, array({zero}), (acc, n) -> concat(acc, array(element_at(acc, -1) + n)))"


def _date_part(pattern: str, y: str, m: str, d: str, kind: str) -> str:
    return f"WHEN t RLIKE r'{pattern}' THEN named_struct('y', {y}, 'm', {m}, 'd', {d}, 'kind', '{kind}')"


#: (signature, type, body), each after those that it calls.
FUNCTIONS = [
    (
        "_value(kind STRING, canonical STRING, number BIGINT, ambiguous BOOLEAN, note STRING, rule STRING)",
        N.VALUE,
        "CASE WHEN canonical IS NOT NULL THEN named_struct('kind', kind, 'canonical', canonical, 'numeric', number, 'ambiguous', coalesce(ambiguous, false), 'note', note, 'domain_rule', rule) END",
    ),
    (
        "_money(n BIGINT, suffix STRING)",
        N.VALUE,
        "_value('money', cast(n AS STRING), n, NULL, if(suffix IS NOT NULL, concat('magnitude shorthand read as ', cast(n AS STRING)), NULL), if(suffix IS NOT NULL, 'money.magnitude-shorthand', NULL))",
    ),
    (
        "_amount(digits STRING, suffix STRING)",
        N.VALUE,
        "_money(cast(floor(try_cast(replace(digits, ',', '') AS DOUBLE) * CASE WHEN suffix IN ('k', 'thousand') THEN 1000 WHEN suffix IN ('m', 'mm', 'million') THEN 1000000 ELSE 1 END + 0.5D) AS BIGINT), suffix)",
    ),
    ("_money_text(t STRING)", N.VALUE, f"_amount({_group(N.AMOUNT, 1)}, {_group(N.AMOUNT, 2)})"),
    ("money_value(raw STRING)", N.VALUE, r"_money_text(lower(trim(regexp_replace(raw, r'\s+', ' '))))"),
    (
        "_count(digits BIGINT, spelled BIGINT)",
        N.VALUE,
        "_value('count', cast(coalesce(digits, spelled) AS STRING), coalesce(digits, spelled), digits <> spelled, "
        "CASE WHEN digits <> spelled THEN 'words and digits disagree' WHEN digits = spelled THEN 'words and digits agree' WHEN spelled IS NOT NULL THEN 'spelled number' END, if(digits = spelled, 'count.dual-assertion', NULL))",
    ),
    ("_count_text(t STRING)", N.VALUE, f"_count(try_cast({_group(N.FEW_DIGITS, 1)} AS BIGINT), cast(try_element_at({_map(N.NUMBER_WORDS)}, {_group(N.NUMBER_WORD, 1)}) AS BIGINT))"),
    ("count_value(raw STRING)", N.VALUE, "_count_text(lower(trim(raw)))"),
    (
        "_date_parts(t STRING)",
        _PART,
        "CASE "
        + _date_part(N.ISO_DATE, *(_group(N.ISO_DATE, k) for k in (1, 2, 3)), "iso")
        + " "
        + _date_part(N.SLASH_DATE, *(_group(N.SLASH_DATE, k) for k in (3, 1, 2)), "slash")
        + " "
        + _date_part(N.NAMED_DATE, _group(N.NAMED_DATE, 3), f"cast(try_element_at({_map(N.MONTHS)}, {_group(N.NAMED_DATE, 1)}) AS STRING)", _group(N.NAMED_DATE, 2), "named")
        + " END",
    ),
    ("_two(n STRING)", "STRING", "lpad(cast(try_cast(n AS INT) AS STRING), 2, '0')"),
    ("_dated(year STRING, month STRING, day STRING, assumed BOOLEAN)", N.VALUE, "_value('date', if(year IS NOT NULL, concat_ws('-', year, _two(month), _two(day)), NULL), NULL, NULL, if(assumed, 'year taken from the document''s date', NULL), NULL)"),
    (
        f"_date(p {_PART}, context STRING)",
        N.VALUE,
        "_dated(if(p.kind = 'slash', cast(if(try_cast(p.y AS INT) < 100, try_cast(p.y AS INT) + 2000, try_cast(p.y AS INT)) AS STRING), coalesce(p.y, context)), p.m, p.d, p.kind = 'named' AND p.y IS NULL)",
    ),
    ("date_value(raw STRING, context_year INT DEFAULT NULL)", N.VALUE, "_date(_date_parts(lower(trim(raw))), cast(context_year AS STRING))"),
    (
        "_vin(bare STRING, folded STRING)",
        N.VALUE,
        "_value('vin', folded, NULL, NULL, if(bare <> folded, 'glyphs outside the alphabet have one legal reading', NULL), if(bare <> folded, 'vin.illegal-glyph-folding', NULL))",
    ),
    ("_vin_text(bare STRING)", N.VALUE, "_vin(bare, translate(bare, 'IOQ', '100'))"),
    ("vin_value(raw STRING)", N.VALUE, "_vin_text(upper(regexp_replace(raw, '[^A-Za-z0-9]', '')))"),
    (
        "_address(tokens ARRAY<STRING>, folded ARRAY<STRING>)",
        N.VALUE,
        "_value('address', array_join(folded, ' '), NULL, NULL, if(folded <> tokens, 'abbreviated within a suffix family', NULL), if(folded <> tokens, 'address.suffix-family-folding', NULL))",
    ),
    ("_address_tokens(tokens ARRAY<STRING>)", N.VALUE, f"_address(tokens, transform(tokens, t -> coalesce(try_element_at({_map(N.DIRECTIONS | N.SUFFIXES)}, t), t)))"),
    ("address_value(raw STRING)", N.VALUE, r"_address_tokens(array_remove(split(trim(regexp_replace(upper(raw), r'[.,\s]+', ' ')), ' '), ''))"),
    (
        f"_limit(amount {N.VALUE}, t STRING, spelled BOOLEAN)",
        N.VALUE,
        r"_value('limit', concat(amount.canonical, ' ', if(spelled OR t RLIKE r'\bcsl\b', 'CSL', 'UNSPECIFIED')), amount.numeric, NULL, amount.note, nullif(concat_ws(' + ', amount.domain_rule, if(spelled, 'limit.basis-from-prose', NULL)), ''))",
    ),
    ("limit_value(raw STRING)", N.VALUE, "_limit(money_value(raw), lower(raw), contains(lower(raw), 'combined single limit'))"),
    ("text_value(raw STRING)", N.VALUE, r"_value('text', lower(regexp_replace(trim(raw), r'\s+', ' ')), NULL, NULL, NULL, NULL)"),
    ("surface(raw STRING)", "STRING", r"upper(trim(regexp_replace(raw, r'\s+', ' ')))"),
    ("_lookalikes(differing ARRAY<STRING>)", "BOOLEAN", f"size(differing) BETWEEN 1 AND 2 AND forall(differing, p -> p IN ({_words(_PAIRS)}))"),
    ("confusable(a STRING, b STRING)", "BOOLEAN", "length(a) = length(b) AND _lookalikes(filter(zip_with(split(a, ''), split(b, ''), (x, y) -> if(x <> y, concat(x, y), NULL)), p -> p IS NOT NULL))"),
    ("similarity(a STRING, b STRING)", "DOUBLE", "if(greatest(length(a), length(b)) = 0, 1.0D, 1 - levenshtein(a, b) / greatest(length(a), length(b)))"),
    (
        "_told(p STRING, q STRING)",
        "STRING",
        f"CASE WHEN p IN ({_words(sorted(set(N.SUFFIXES.values())))}) AND q IN ({_words(sorted(set(N.SUFFIXES.values())))}) THEN concat('different street suffix (', p, ' vs ', q, ')') "
        f"WHEN p IN ({_words(sorted(set(N.DIRECTIONS.values())))}) AND q IN ({_words(sorted(set(N.DIRECTIONS.values())))}) THEN concat('different directional (', p, ' vs ', q, ')') "
        "WHEN p RLIKE '^[0-9]+$' AND q RLIKE '^[0-9]+$' THEN concat('different street number (', p, ' vs ', q, ')') END",
    ),
    ("_told_apart(differing ARRAY<STRUCT<p: STRING, q: STRING>>)", "STRING", "if(size(differing) = 1, _told(get(differing, 0).p, get(differing, 0).q), NULL)"),
    ("distinguishing_token(a STRING, b STRING)", "STRING", f"if(size(split(a, ' ')) = size(split(b, ' ')), _told_apart({_DIFFERING}), NULL)"),
    ("dollars(n BIGINT)", "STRING", "concat('$', format_number(n, 0))"),
    ("percentage(n BIGINT, of BIGINT)", "STRING", "if(n IS NULL OR of IS NULL OR of = 0, '—', format_string('%.1f%%', try_divide(n * 100.0D, of)))"),
    ("percentage_of(n BIGINT, of BIGINT)", "STRING", "concat(percentage(n, of), format_string(' (%d of %d)', n, of))"),
    ("listed(items ARRAY<STRING>)", "STRING", "if(size(items) <= 1, array_join(items, ''), concat(array_join(slice(items, 1, greatest(size(items) - 1, 1)), ', '), ' and ', try_element_at(items, -1)))"),
    ("unit_number(entity_key STRING)", "INT", "try_cast(regexp_extract(entity_key, '^vehicle:unit-([0-9]+)$', 1) AS INT)"),
    ("entity_label(entity_key STRING)", "STRING", "CASE WHEN unit_number(entity_key) IS NOT NULL THEN concat('Unit ', unit_number(entity_key)) WHEN startswith(entity_key, 'loss:') THEN concat('Claim ', substring(entity_key, 6)) ELSE 'Policy' END"),
    ("is_table_line(line STRING)", "BOOLEAN", "regexp_count(line, '[|]') >= 3"),
    ("is_rule_line(line STRING)", "BOOLEAN", r"line RLIKE r'^[\s\-+=|]{5,}$' AND line RLIKE '[-=]'"),
    # Sums run chunk by chunk, as in the Column form.
    (
        "_chunk_sums(chunks ARRAY<ARRAY<INT>>, bases ARRAY<INT>)",
        "ARRAY<INT>",
        f"flatten(transform(chunks, (c, k) -> slice({_RUN.format(lengths='c', zero='get(bases, k)')}, 1, size(c))))",
    ),
    ("_chunked(chunks ARRAY<ARRAY<INT>>)", "ARRAY<INT>", f"_chunk_sums(chunks, {_RUN.format(lengths='transform(chunks, c -> aggregate(c, 0, (a, n) -> a + n))', zero='0')})"),
    ("_sums(lengths ARRAY<INT>)", "ARRAY<INT>", f"_chunked(transform(sequence(0, greatest(size(lengths) - 1, 0), {CHUNK}), i -> slice(lengths, i + 1, {CHUNK})))"),
    ("_placed_lines(cut ARRAY<STRING>)", "ARRAY<STRUCT<text: STRING, start: INT>>", "zip_with(cut, _sums(transform(cut, p -> length(p) + 1)), (t, s) -> struct(t AS text, s AS start))"),
    ("text_lines(text STRING)", "ARRAY<STRUCT<text: STRING, start: INT>>", r"_placed_lines(split(text, r'\n', -1))"),
    (
        "_placed_cells(cut ARRAY<STRING>, base INT)",
        _SPAN,
        "zip_with(cut, _sums(transform(cut, p -> length(p) + 1)), (p, s) -> named_struct('value', trim(p), 'start', base + s + length(p) - length(ltrim(p)), 'end', base + s + length(p) - length(ltrim(p)) + length(trim(p))))",
    ),
    ("line_cells(line STRING, start INT)", _SPAN, "_placed_cells(split(line, '[|]', -1), start)"),
    (
        "_placed_matches(whole ARRAY<STRING>, steps ARRAY<INT>)",
        "ARRAY<STRUCT<start: INT, raw: STRING>>",
        "zip_with(whole, zip_with(_sums(steps), steps, (b, k) -> b + k), (m, e) -> struct(e - length(m) AS start, m AS raw))",
    ),
    ("_gapped_matches(whole ARRAY<STRING>, gaps ARRAY<STRING>)", "ARRAY<STRUCT<start: INT, raw: STRING>>", "_placed_matches(whole, zip_with(slice(gaps, 1, size(whole)), whole, (g, m) -> length(g) + length(m)))"),
    ("text_matches(text STRING, pattern STRING)", "ARRAY<STRUCT<start: INT, raw: STRING>>", "_gapped_matches(regexp_extract_all(text, pattern, 0), split(text, pattern, -1))"),
]


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session, and returns the names of those for use."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    names = [signature.partition("(")[0] for signature, _, _ in FUNCTIONS]
    return [n for n in names if not n.startswith("_")]

"""SQL for the queries over wild sheets, for an engine that knows the driver's tables only."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from partloom import constants as C
from partloom.operators.tables import field_words
from partloom.plans.oracle import _BANNER, _SHEET, _TOTAL, _aliases, _case, _in, _list, _matched, _q, _values, _with, clean, mpn_key, package
from partloom.sources.views import with_views

_KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


def _by_pattern(*texts: str) -> str:
    return " ".join(f"when {' or '.join(f'regexp_matches({t}, {_q(p)})' for t in texts for p in several)} then '{field}'" for field, several in C.FIELD_PATTERNS.items())


def _rated(source: str) -> str:
    """key columns k, header score and hits of rows (k, cells) of source."""
    return f"""select k, hits, case when n < 2 then 0 else greatest(0.0::double, hits * 12.0::double + needed * 10.0::double + hits / n * 25.0::double + n / width * 12.0::double + keys / n * 10.0::double - numeric / n * 40.0::double - long / n * 25.0::double + case when needed >= 2 then 18.0::double else 0.0::double end) end as score, n, numeric
        from (select k, any_value(width) as width, count(*) as n, count(field) as hits, count(*) filter (field in ('mpn', 'quantity')) as needed, count(*) filter (regexp_matches(c, '^-?[\\d.,]+$')) as numeric, count(*) filter (length(c) > 48) as long, count(distinct key) as keys
        from (select k, width, c, key, case when key <> '' then coalesce(w.field, case {_by_pattern('key')} end) end as field from (select k, len(cells) as width, unnest(list_filter(cells, lambda x: x <> '')) as c, {_KEY.format('c')} as key from {source}) left join words w on w.k1 = key) group by k)"""


_SLICED = "list_transform(range(first_col, last_col), lambda i: coalesce(x[i + 1], ''))"
_PIECE = "case when p <> '' and not contains(lower(l), lower(p)) then trim(l || ' ' || p) else l end"
_REGIONS = {
    "words(k1, field, weight)": "values " + ", ".join(f"('{k}', '{f}', {w}::double)" for k, (f, w) in field_words().items()),
    "cells": f"select sheet, row_no, list_transform(string_split(cells_text, '|'), lambda c: {clean('c')}) as cells from v_wild",
    "early": "select sheet, row_no, {'sheet': sheet, 'row_no': row_no} as k, cells from cells where row_no <= 40",
    "rated": _rated("early"),
    "best": "select k.sheet as sheet, arg_max(k.row_no, (score - (k.row_no - 1) * 0.35::double, -k.row_no)) as row_no, arg_max(hits, (score - (k.row_no - 1) * 0.35::double, -k.row_no)) as hits, max(score - (k.row_no - 1) * 0.35::double) as score from rated where n >= 2 and score - (k.row_no - 1) * 0.35::double > 0 group by all",
    "guess": "select k.sheet as sheet, min(k.row_no) as row_no, arg_min(hits, k.row_no) as hits from rated where n >= 2 and k.row_no <= 10 group by all",
    "heads": "select g.sheet, case when b.hits > 0 then b.row_no else g.row_no end as header_row, case when b.hits > 0 then b.hits else g.hits end as hits, case when b.hits > 0 then b.score else 1.0::double end as score from guess g left join best b using (sheet)",
    "near": """select sheet, any_value(header_row) as header_row, any_value(hits) as hits, any_value(score) as score, max(len(cells)) as width, max(case when row_no = header_row - 1 then cells end) as above, max(case when row_no = header_row then cells end) as base, max(case when row_no = header_row + 1 then cells end) as below,
        coalesce(max(list_max(list_filter(range(1, len(cells) + 1), lambda i: cells[i] <> ''))) filter (row_no - header_row between 1 and 29), 0) as reach from cells join heads using (sheet) group by sheet""",
    "spans": """select *, list_min(list_filter(range(1, len(base) + 1), lambda i: base[i] <> '')) - 1 as first_col, case when reach > list_max(list_filter(range(1, len(base) + 1), lambda i: base[i] <> '')) then width else list_max(list_filter(range(1, len(base) + 1), lambda i: base[i] <> '')) end as last_col from near""",
    "cuts": f"select sheet, first_col, last_col, side, {_SLICED} as x from (select sheet, first_col, last_col, unnest([{{'side': 'above', 'x': coalesce(above, [])}}, {{'side': 'base', 'x': base}}, {{'side': 'below', 'x': coalesce(below, [])}}], recursive := true) from spans)",
    "sides": "select {'sheet': sheet, 'side': side} as k, x as cells from cuts where side <> 'base'",
    "side_rated": _rated("sides"),
    "judged": """select o.sheet, o.side, o.x, coalesce(r.n, 0) as n, len(list_filter(b.x, lambda c: c <> '')) as nb, len(list_filter(range(1, len(b.x) + 1), lambda i: b.x[i] <> '' and o.x[i] <> '')) as ab, r.hits, r.score, r.numeric
        from cuts o join cuts b on o.sheet = b.sheet and b.side = 'base' left join side_rated r on r.k.sheet = o.sheet and r.k.side = o.side where o.side <> 'base'""",
    "belongs": "select sheet, side, x, n > 0 and n <= nb and ((n - ab >= 1 and n - ab >= ab) or coalesce(ab > 0 and n between 2 and greatest(2, nb // 2) and hits >= 1 and score >= 20 and numeric = 0, false)) as fits from judged",
}
# Labels: the base's cell, what the row above adds, what the row below adds.
_one = lambda base, a, u: f"list_reduce([{base}, {a}, {u}], lambda l, p: {_PIECE})"
_REGIONS["labelled"] = f"""select b.sheet, list_transform(range(1, len(b.x) + 1), lambda i: {_one('b.x[i]', "case when a.fits then a.x[i] else '' end", "case when u.fits then u.x[i] else '' end")}) as header, u.fits as two
    from cuts b join belongs a on a.sheet = b.sheet and a.side = 'above' join belongs u on u.sheet = b.sheet and u.side = 'below' where b.side = 'base'"""
_REGIONS |= {
    "regions": "select sheet, header_row, hits, score, first_col, last_col, header, case when two then 2 else 1 end as header_rows from spans join labelled using (sheet)",
    "body": f"select sheet, row_no, {_SLICED.replace('x[i + 1]', 'cells[i + 1]')} as cells from cells join regions using (sheet) where row_no >= header_row + header_rows",
    "flagged": f"""select *, list_filter(cells, lambda c: c <> '') as filled, coalesce(len(filled) = 1 and (regexp_matches(filled[1], '{_BANNER}') or regexp_matches(filled[1], '^[\\-=*_\\s#]{{3,}}$')), false) as banner, coalesce(regexp_matches(filled[1], '{_TOTAL}') and len(filled) <= 5, false) as total from body""",
    "lasts": "select sheet, max(row_no) as last_full from flagged where len(filled) >= 3 group by sheet",
    "ends": "select f.sheet, min(row_no) as end_row from flagged f left join lasts l using (sheet) where total and not banner and row_no >= coalesce(last_full, 0) group by f.sheet",
    "data": "select f.sheet, f.row_no, f.cells from flagged f left join ends e using (sheet) where len(filled) > 0 and not banner and not total and (end_row is null or row_no < end_row)",
}

# What cells look like
_TEXT = "text"
_BODY = r"trim(regexp_replace(regexp_replace(text, '(?i)\b(pcs?|pieces?|ea|each|nos?|qty|units?|off)\b', ' ', 'g'), '[xX]', ' ', 'g'))"
_MONEY = r"regexp_replace(regexp_extract(text, '-?\d[\d,.\s'']*'), '[\s'']', '', 'g')"
_PROFILE = {
    "sampled": "select sheet, row_no, unnest(range(len(cells)))::int as col, unnest(cells) as text from data qualify dense_rank() over (partition by sheet order by row_no) <= 60",
    "seen": "select * from sampled where text <> ''",
    "distinct_texts": "select distinct text from seen",
} | {f"p_{k}": re.sub(r"\bfrom (texts|shapes|split|units|kinds|scaled)\b", r"from p_\1", v) for k, v in _values("text", "distinct_texts").items()} | {
    "numbers": rf"select text, kind, {_BODY} as body, {_MONEY} as m, regexp_matches(text, {_q(C.REFDES_CELL)}) as is_ref from p_parsed",
    "facts": rf"""select text, try_cast(nullif(regexp_extract(case when regexp_matches(body, '^-?\d+,\d{{1,2}}$') then replace(body, ',', '.') else regexp_replace(body, '[^0-9.\-]', '', 'g') end, '-?\d+(?:\.\d+)?'), '') as double) as q,
        try_cast(regexp_replace(case when m = '' then 'x' when contains(m, ',') and contains(m, '.') then case when regexp_matches(m, ',[^.]*$') then replace(replace(m, '.', ''), ',', '.') else replace(m, ',', '') end when len(m) - len(replace(m, ',', '')) > 1 or regexp_matches(m, ',...$') then replace(m, ',', '') else replace(m, ',', '.') end, '\.$', '') as decimal(18,6)) is not null as money,
        is_ref, is_ref and (regexp_matches(text, '[,;/ ]') or (contains(text, '-') and regexp_extract(text, '(\d+)\s*-', 1) <> regexp_extract(text, '-\s*[A-Za-z]*(\d+)', 1))) as many, case when is_ref then regexp_extract_all(upper(text), '([A-Z]{{1,4}})\d', 1) else [] end as prefixes,
        regexp_replace(upper(text), '[^A-Z0-9]+', '', 'g') in {_in(C.MAKER_HINTS)} as maker, regexp_replace(upper(text), '[^A-Z0-9]+', '', 'g') in {_in(C.SELLER_HINTS)} as seller,
        regexp_matches(text, '{C.MPN_CELL}') and regexp_matches(text, '[0-9]') as mpn, contains(text, ' ') and length(text) > 12 as wordy, kind is not null and length(text) <= 16 as value, regexp_matches(text, {_q(C.DNP_CELL)}) as dnp from numbers""",
    "shares": """select sheet, col, count(*) as total, count(*) filter (q >= 0 and length(text) <= 12) / count(*) as quantity, count(*) filter (coalesce(q = floor(q), true)) / count(*) as whole, count(*) filter (coalesce(q, 0) between 0 and 5000) / count(*) as small,
        count(*) filter (money) / count(*) as money, count(*) filter (regexp_matches(text, '[.,]')) / count(*) as decimals, count(*) filter (regexp_matches(text, '[$€£¥₹]')) / count(*) as symbol, count(*) filter (is_ref) / count(*) as refdes, count(*) filter (many) / count(*) as many_refs,
        count(*) filter (maker) / count(*) as maker, count(*) filter (seller) / count(*) as seller, count(*) filter (mpn) / count(*) as mpn, count(*) filter (wordy) / count(*) as wordy, count(*) filter (value) / count(*) as value, count(*) filter (regexp_matches(upper(text), '^[A-Z]{3}$')) / count(*) as currency,
        count(*) filter (dnp) / count(*) as dnp, count(*) filter (contains(text, '%')) / count(*) as tolerance, count(distinct upper(text)) / count(*) as cardinality, count(distinct lower(text)) as lowers, flatten(list(prefixes)) as prefixes, list(coalesce(q, 0) order by row_no) as qs from seen join facts using (text) group by sheet, col""",
    "numbered": f"select *, len(list_intersect(list_distinct(prefixes), {_list(C.REFDES_PREFIXES)})) as common, total >= 5 and whole = 1 and len(list_distinct(list_transform(range(1, len(qs) + 1), lambda i: qs[i] - i))) = 1 as run from shares",
    "looks": "select sheet, col, total, field, score from (select sheet, col, total, unnest([" + ", ".join(f"{{'field': '{f}', 'score': ({s})::double}}" for f, s in {
        "quantity": "case when quantity > 0.85 then case when run then 25.0::double else 40.0::double + 30.0::double * whole + 25.0::double * small end end", "line_id": "case when quantity > 0.85 and run then 88.0::double end",
        "unit_price_in": "case when money > 0.8 and (decimals > 0.5 or symbol > 0.2) then 45.0::double + 30.0::double * decimals + 25.0::double * symbol end",
        "ref_designators": "case when refdes > 0.6 then least(100.0::double, 45.0::double + 25.0::double * refdes + 18.0::double * many_refs + case when common > 0 then 8.0::double + least(9.0::double, 3.0::double * common) else 0.0::double end) end",
        "manufacturer": "case when maker > 0.25 then 50.0::double + 50.0::double * least(1.0::double, maker * 1.5::double) end", "distributor": "case when seller > 0.3 then 55.0::double + 45.0::double * seller end",
        "mpn": "case when mpn > 0.55 and cardinality > 0.4 then 35.0::double + 35.0::double * mpn + 30.0::double * cardinality end", "description": "case when wordy > 0.6 then 40.0::double + 50.0::double * wordy end",
        "value": "case when value > 0.5 then 35.0::double + 45.0::double * value end", "currency": "case when currency > 0.8 then 90.0::double end", "dnp": "case when dnp > 0.85 and lowers <= 4 then 70.0::double end", "tolerance": "case when tolerance > 0.7 then 80.0::double end",
    }.items()) + "], recursive := true) from numbered) where score is not null",
}


# What headers say. Similarity is computed here, by its definition, for the headers that the sheets have.
def _likeness(a: str, b: str) -> float:
    plain = lambda x, y: 100.0 if x == y else SequenceMatcher(None, x, y).ratio() * 100.0
    short, long = sorted((a, b), key=len)
    window = 100.0 if short in long else max(plain(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))
    words = 100.0 if a == b else max(0.0, plain(a.upper(), b.upper()))
    return max(plain(a, b), 0.95 * window, 0.97 * words)


_KEYS = (
    "line mpn manufacturer qty referencedesignator description unitprice currency dnp alternates notes lot partno brand usage designators bezeichnung rateeur populate alt1 alt2 remarks mfrpartnumberprimary quantty discription footprint tol item "
    "itemno mfr partnumber costeach case refdes seq namemanufacturer partnumbermanufacturer val level sku qnty warehousebin distributor digikey value volts secondsource"
).split()
_SPELLED = [("".join(c for c in s.lower() if c.isalnum()), f) for f, several in C.FIELD_WORDS.items() for s in several]
_NEAR = [(k, f, s * 0.9) for k in _KEYS for s, f in [max(((_likeness(k, s), f) for s, f in _SPELLED), key=lambda x: x[0])] if s >= 82]
_INSIDE = [(f, sorted(set("".join(c if c.isalnum() else " " for c in s.upper()).split()))) for f, several in C.FIELD_WORDS.items() for s in several]
_NAMES = "|".join(k.split("(")[0] for k in _SHEET)
_LEARNED = {f"s_{k}": re.sub(rf"\b(from|join) ({_NAMES})\b", r"\1 s_\2", v) for k, v in _SHEET.items()}
_MAPPING = {
    "labels": "select sheet, unnest(range(len(header)))::int as col, unnest(header) as label from regions",
    "distinct_labels": f"select distinct label, {_KEY.format('label')} as key, list_filter(string_split_regex(upper(label), '[^A-Z0-9]+'), lambda t: t <> '') as tokens from labels where {_KEY.format('label')} <> ''",
    "known_keys(key, field, hits)": "select key, field, hits from (select key, field, count(*)::int as hits from (select " + _KEY.format("cells[\"column\" + 1]") + " as key, field from s_mapped join s_heads using (sheet) join s_filled using (sheet) where row_no = header_row) where key <> '' group by key, field) qualify row_number() over (partition by key order by hits desc, field) = 1",
    "near_keys(key, field, score)": "values " + ", ".join(f"('{k}', '{f}', {s!r}::double)" for k, f, s in _NEAR),
    "said": "select label, 1 as tier, field, weight as score from distinct_labels join words on k1 = key union all select label, 2, field, least(99.0::double, 84.0::double + least(hits, 15)) from distinct_labels join known_keys using (key) union all "
        + " union all ".join(f"select label, 3, '{f}', 78.0::double from distinct_labels where {' or '.join(f'regexp_matches({t}, {_q(p)})' for t in ('key', 'lower(label)') for p in several)}" for f, several in C.FIELD_PATTERNS.items()),
    "clear": "select label from said where score >= 80",
    "more": "select * from said union all select label, 4, field, score from distinct_labels join near_keys using (key) where label not in (select label from clear) union all "
        + " union all ".join(f"select label, 5, '{f}', 80.0::double from distinct_labels where list_has_all(tokens, {_list(words)})" for f, words in _INSIDE if len(words) > 1),
    "scores": "select label, field, max(score) as score, arg_max(tier, (score, -tier)) as tier from more group by all",
    "by_header": f"select l.sheet, l.col, s.field, s.tier, case when coalesce(k.score, 0) >= 50 then least(100.0::double, s.score + 8.0::double) when s.field in {_in(C.CONTENT_FIELDS)} and exists (select 1 from looks o where o.sheet = l.sheet and o.col = l.col) then s.score - 12.0::double else s.score end as score from labels l join scores s using (label) left join looks k on k.sheet = l.sheet and k.col = l.col and k.field = s.field",
    "alone": "select k.sheet, k.col, k.field, 6 as tier, k.score * case when l.label <> '' then 0.72::double else 0.8::double end as score from looks k join labels l using (sheet, col) where total >= 2 and k.score >= case when l.label <> '' then 88.0::double else 70.0::double end and not exists (select 1 from scores s where s.label = l.label and s.field = k.field)",
    "ranked": "select *, row_number() over (partition by sheet order by score desc, col, field) as place from (select * from by_header union all select * from alone) where score >= 55",
    "turns": """select sheet, 0::bigint as place, []::int[] as cols, []::varchar[] as fields, null::int as col, null::varchar as field, null::double as score, null::int as tier from regions
        union all select t.sheet, r.place, case when free then list_append(t.cols, r.col) else t.cols end, case when free then list_append(t.fields, r.field) else t.fields end, case when free then r.col end, r.field, r.score, r.tier
        from turns t join ranked r on r.sheet = t.sheet and r.place = t.place + 1, lateral (select not list_contains(t.cols, r.col) and (r.field = 'alt_mpns' or not list_contains(t.fields, r.field)) as free)""",
    "mapping": "select sheet, col, field, score, tier from turns where col is not null",
}


def _recursive(ctes: dict[str, str], sql: str) -> str:
    return _with(ctes, sql).replace("with ", "with recursive ", 1)


_ALL = _REGIONS | _PROFILE | _LEARNED | _MAPPING
_LAYOUTS = _REGIONS | {
    "keyed": f"select sheet, score, list_sort(list_distinct(list_filter(list_transform(header, lambda h: {_KEY.format('h')}), lambda k: k <> ''))) as keys from regions",
    "layouts": "select *, substr(sha1(array_to_string(keys, '|')), 1, 16) as layout from keyed where len(keys) > 0",
    "kinds": "select layout, any_value(keys) as keys from layouts group by layout",
    "pairs": "select a.layout, b.layout as other, len(list_intersect(a.keys, b.keys)) as shared, len(list_intersect(a.keys, b.keys)) / (len(a.keys) + len(b.keys) - len(list_intersect(a.keys, b.keys))) as similarity from kinds a join kinds b on a.layout < b.layout",
}
_MILLE = "floor(similarity * 1000 + 0.5)::bigint"
SQL: dict[str, str] = {
    "table_regions": _with(_REGIONS, "select sheet, header_row, hits::int as hits, first_col::int as first_col, last_col::int as last_col, header_rows::int as header_rows, array_to_string(header, '|') as header from regions"),
    "table_rows": _with(_REGIONS, "select sheet, count(*) as rows, sum(row_no)::bigint as row_numbers, sum(len(list_filter(cells, lambda c: c <> '')))::bigint as filled from data group by sheet"),
    "column_looks": _with(_REGIONS | _PROFILE, 'select sheet, col as "column", field, floor(score * 100 + 0.5)::bigint as hundredths from looks'),
    "column_mapping": _recursive(_ALL, 'select sheet, col as "column", field, floor(score * 100 + 0.5)::bigint as hundredths, tier::int as tier from mapping'),
    "layouts_alike": _with(_LAYOUTS, f"select layout, other, shared::int as shared, {_MILLE} as similarity from pairs where similarity >= 0.8"),
    "compatible_sheets": _with(
        _LAYOUTS
        | {"sizes": "select sheet, count(*) as n from data group by sheet",
           "qualities": f"select r.sheet, r.score + least(30.0::double, sqrt(n) * 2.0::double) + least(12.0::double, (last_col - first_col) * 0.6::double) + case when r.sheet % 3 = 0 then 20.0::double else 0 end - case when r.sheet % 3 = 2 then 30.0::double else 0 end as quality from regions r join sizes using (sheet)",
           "valued": "select l.sheet // 10 as workbook, l.sheet, l.layout, q.quality from layouts l join qualities q using (sheet)",
           "firsts": "select workbook, arg_max(sheet, (quality, -sheet)) as best_sheet, arg_max(layout, (quality, -sheet)) as best_layout from valued group by workbook",
           "both_ways": "select layout, other, similarity from pairs where similarity >= 0.8 union all select other, layout, similarity from pairs where similarity >= 0.8"},
        f"select r.workbook, r.sheet, r.sheet = b.best_sheet as best, case when r.layout = b.best_layout then 1000 else {_MILLE} end as similarity from valued r join firsts b using (workbook) left join both_ways w on w.layout = r.layout and w.other = b.best_layout where r.layout = b.best_layout or w.similarity is not null",
    ),
}

# Typed lines
_WORDS = lambda x: f"list_filter(string_split_regex(upper({x}), '[^A-Z0-9]+'), lambda t: t <> '')"
_JOINED = lambda x: f"array_to_string({_WORDS(x)}, '')"
_DNP = lambda x: f"(list_has_any({_WORDS(x)}, {_list(C.DNP_TOKENS)}) or {_JOINED(x)} in {_in(C.DNP_TOKENS)} or regexp_matches({x}, '(?i)\\bdo\\s*not\\s*(populate|place|install|fit|load)\\b'))"
_PLACEHOLDER = lambda x: f"(lower({x}) in {_in(C.PLACEHOLDER_CELLS)})"
_NUMBER = lambda x: rf"regexp_replace(regexp_extract({x}, '-?\d[\d,.\s'']*'), '[\s'']', '', 'g')"
_PARTS = lambda x: f"list_filter(list_transform(string_split_regex({x}, '[,;|]+| / '), lambda p: trim(p)), lambda p: p <> '')"
_SINGLE = tuple(f for f in C.FIELD_WORDS if f != "alt_mpns")


def _votes(name: str) -> str:
    """Two counts over the texts of a column: cells that a decimal comma explains, cells with a decimal point."""
    both, lone = "contains(x, ',') and contains(x, '.')", "len(x) - len(replace(x, '{0}', '')) = 1 and len(regexp_extract(x, '[^{0}]*$')) <> 3"
    return f"""select sheet, count(*) filter (case when {both} then regexp_matches(x, ',[^.]*$') else {lone.format(',')} end) as commas, count(*) filter (case when {both} then not regexp_matches(x, ',[^.]*$') else not contains(x, ',') and len(x) - len(replace(x, '.', '')) = 1 and len(regexp_extract(x, '[^.]*$')) <> 3 end) as points
        from (select sheet, {_NUMBER(name)} as x from told) group by sheet"""


_BODY_Q = _BODY.replace("text", "quantity")
_TYPED = _ALL | {
    "places": "select sheet, list(col order by col) filter (field = 'alt_mpns') as c_alts, " + ", ".join(f"max(col) filter (field = '{f}') as c_{f}" for f in _SINGLE) + " from mapping group by sheet",
    "told": "select d.sheet, d.row_no, coalesce(list_transform(p.c_alts, lambda i: d.cells[i + 1]), []) as alternates, " + ", ".join(f"coalesce(d.cells[p.c_{f} + 1], '') as {f}" for f in _SINGLE) + " from data d join places p using (sheet)",
    "price_votes": _votes("unit_price_in"), "quantity_votes": _votes("quantity"),
    "senses": f"""select r.sheet, list_has_any({_WORDS("coalesce(r.header[p.c_dnp + 1], '')")}, {_list(C.FIT_HEADERS)}) and not list_has_any({_WORDS("coalesce(r.header[p.c_dnp + 1], '')")}, {_list(C.UNFIT_HEADERS)}) as fits,
        list_filter(list_transform(regexp_extract_all(upper(coalesce(r.header[p.c_unit_price_in + 1], '')), '\\b[A-Z]{{3}}\\b|[$€£¥₹]'), lambda c: {_case('c', C.CURRENCY_SYMBOLS)}), lambda c: c is not null)[1] as header_currency,
        a.commas > 0 and a.commas >= a.points as price_comma, (q.commas > 0 and q.commas >= q.points) or (a.commas > 0 and a.commas >= a.points) as quantity_comma
        from regions r join places p using (sheet) join price_votes a using (sheet) join quantity_votes q using (sheet)""",
    "makers(k, name)": "values " + ", ".join(f"({_q(k)}, {_q(n)})" for k, n in _aliases(C.MAKER_ALIASES).items()),
    "maker_words": f"select manufacturer, {_WORDS('manufacturer')} as all_words, list_filter(all_words, lambda w: w not in {_in(C.COMPANY_NOISE)}) as kept_words, case when len(kept_words) > 0 then kept_words else all_words end as shown from (select distinct manufacturer from told)",
    "maker_names": "select manufacturer, case when manufacturer = '' then '' else coalesce(a.name, b.name, array_to_string(list_transform(shown, lambda w: case when regexp_matches(w, '^[A-Z]{1,3}$') then w else w[1] || lower(w[2:]) end), ' ')) end as maker from maker_words left join makers a on a.k = array_to_string(all_words, '') left join makers b on b.k = array_to_string(shown, '')",
    "firsts_of": f"select t.*, s.* exclude (sheet), m.maker, t.mpn <> '' and {_DNP('t.mpn')} as flag, case when {_PLACEHOLDER('t.mpn')} or flag then '' else t.mpn end as own0, {_PARTS('own0')} as parts, contains(own0, ',') and len(parts) > 1 and len(list_filter(parts, lambda p: len(p) < 4)) = 0 as several from told t join senses s using (sheet) join maker_names m using (manufacturer)",
    "owned": f"""select *, case when several then parts[1] else own0 end as own, list_concat(flatten(list_transform(alternates, lambda a: {_PARTS('a')})), case when several then parts[2:] else [] end) as others, case when {_PLACEHOLDER('distributor_pn')} then '' else distributor_pn end as sku,
        case when ref_designators = '' or {_PLACEHOLDER('ref_designators')} then [] when regexp_matches(ref_designators, '^[A-Z]\\d+-[A-Z]\\d+$') then list_transform(range(regexp_extract(ref_designators, '(\\d+)-', 1)::int, regexp_extract(ref_designators, '-[A-Z](\\d+)', 1)::int + 1), lambda n: ref_designators[1] || n::varchar)
          else list_transform(string_split_regex(ref_designators, '[, ]+'), lambda p: trim(p)) end as every_ref, list_filter(every_ref, lambda p, i: not list_contains(every_ref[1:i - 1], p)) as refs0,
        {_JOINED('dnp')} as word from firsts_of""",
    "read": f"""select *, list_filter(others, lambda p: not {_PLACEHOLDER('p')} and upper(p) <> upper(own)) as alts0,
        case when dnp = '' then {_DNP('notes')} or {_DNP('description')} or {_DNP('ref_designators')} or {_DNP('line_id')} or (flag and {_DNP('mpn')}) when fits then case when word in {_in(C.UNFIT_WORDS)} then true when word in {_in(C.FIT_WORDS)} then false else {_DNP('dnp')} end
          when word in {_in((*C.FIT_WORDS, 'DNP', 'DNI', 'DNF', 'X'))} then true when word in ('NO', 'N', 'FALSE', '0') then false else {_DNP('dnp')} end as out,
        try_cast(nullif(regexp_extract(case when quantity_comma and regexp_matches({_BODY_Q}, '^-?[\\d.]+(,\\d+)?$') then replace(replace({_BODY_Q}, '.', ''), ',', '.') when not quantity_comma and regexp_matches({_BODY_Q}, '^-?\\d+,\\d{{1,2}}$') then replace({_BODY_Q}, ',', '.') else regexp_replace({_BODY_Q}, '[^0-9.\\-]', '', 'g') end, '-?\\d+(?:\\.\\d+)?'), '') as double) as read_quantity,
        {_NUMBER('unit_price_in')} as x, coalesce({', '.join(f"case when contains(upper(unit_price_in), {_q(k)}) then {_q(C.CURRENCY_SYMBOLS[k])} end" for k in sorted(C.CURRENCY_SYMBOLS, key=len, reverse=True))}) as cell_currency from owned""",
    "judged_lines": f"""select *, list_filter(alts0, lambda p, i: len(list_filter(alts0[1:i - 1], lambda o: upper(o) = upper(p))) = 0) as alts, own = '' and sku = '' as blank, {_JOINED('description')} in {_in(C.NO_PART_TOKENS)} or {_JOINED('notes')} in {_in(C.NO_PART_TOKENS)} or {_JOINED('mpn')} in {_in(C.NO_PART_TOKENS)} as marked, {_JOINED('own')} in {_in(C.NO_PART_TOKENS)} as no_part,
        case when x = '' then null else try_cast(regexp_replace(case when contains(x, ',') and contains(x, '.') then case when regexp_matches(x, ',[^.]*$') then replace(replace(x, '.', ''), ',', '.') else replace(x, ',', '') end when len(x) - len(replace(x, ',', '')) > 1 then replace(x, ',', '') when regexp_matches(x, ',...$') and not price_comma then replace(x, ',', '') else replace(x, ',', '.') end, '\\.$', '') as decimal(18,6)) end as amount from read""",
}
_ISSUES = """array_to_string(list_filter([case when read_quantity is not null then null when len(refs0) > 0 then 'qty_from_refdes:info' when quantity <> '' then 'qty_unparsed:warning' else 'qty_blank:info' end,
    case when blank and marked then 'no_part_marker:info' when blank and not out then 'mpn_missing:error' when not blank and no_part then 'mpn_placeholder:warning' end], lambda i: i is not null), ',')"""
_LINES = f"""select sheet, row_no, row_number() over (partition by sheet order by row_no)::int as line_no, case when not blank and no_part then '' else own end as mpn, maker as manufacturer, internal_pn, description, distributor, sku as distributor_pn, value, package, tolerance, notes, level,
    array_to_string(alts, ',') as alt_mpns, array_to_string(refs0, ',') as refs, out as dnp, coalesce(read_quantity, case when len(refs0) > 0 then len(refs0)::double else 1.0::double end) as quantity,
    (amount::decimal(38,6) * 1000000)::bigint as price_micro, case when unit_price_in = '' then '' else coalesce(nullif(currency, ''), cell_currency, header_currency, '') end as currency, {_ISSUES} as issues from judged_lines"""
SQL |= {
    "typed_lines": _recursive(_TYPED, _LINES),
    "united_lines": _recursive(
        _TYPED
        | {k: v for k, v in _LAYOUTS.items() if k not in _REGIONS}
        | {"sizes": "select sheet, count(*) as n from data group by sheet",
           "qualities": "select r.sheet, r.score + least(30.0::double, sqrt(n) * 2.0::double) + least(12.0::double, (last_col - first_col) * 0.6::double) + case when r.sheet % 3 = 0 then 20.0::double else 0 end - case when r.sheet % 3 = 2 then 30.0::double else 0 end as quality from regions r join sizes using (sheet)",
           "valued": "select l.sheet // 10 as workbook, l.sheet, l.layout, q.quality from layouts l join qualities q using (sheet)",
           "firsts": "select workbook, arg_max(sheet, (quality, -sheet)) as best_sheet, arg_max(layout, (quality, -sheet)) as best_layout from valued group by workbook",
           "both_ways": "select layout, other from pairs where similarity >= 0.8 union all select other, layout from pairs where similarity >= 0.8",
           "together": "select r.workbook, r.sheet, r.sheet = b.best_sheet as best from valued r join firsts b using (workbook) where r.layout = b.best_layout or exists (select 1 from both_ways w where w.layout = r.layout and w.other = b.best_layout)",
           "lines_of": _LINES},
        "select workbook, sheet, row_no, row_number() over (partition by workbook order by best desc, sheet, row_no) as line_no, mpn, quantity from lines_of join together using (sheet)",
    ),
}


# Completions. The similarity of the makers' two spellings is computed here, by its definition.
def _blend(a: str, b: str) -> float:
    plain = lambda x, y: 0.0 if not x or not y else 100.0 if x == y else SequenceMatcher(None, x, y).ratio() * 100.0
    short, long = sorted((a, b), key=len)
    window = 100.0 if short in long else max(plain(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))
    x, y = (set(re.findall("[A-Z0-9]+", s.upper())) for s in (a, b))
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    whole = [" ".join(filter(None, (both, s))) for s in (one, two)]
    return max(plain(a, b), 0.95 * window, 0.97 * max(plain(both, whole[0]), plain(both, whole[1]), plain(*whole)))


_SPELLINGS = [(f"Brnd#{n}", f"Brand#{n}", _blend(f"Brnd {n}", f"Brand#{n}")) for n in range(1, 60)] + [
    (a, f"Brand#{n}", _blend(b, f"Brand#{n}")) for a, b in (("Other Works", "Other Works"),) for n in range(1, 60)
]
_GAPS = _matched("select * replace (replace(manufacturer, ' Corp.', '') as manufacturer) from v_gap_line", "select * from v_part") | {
    "spellings(given, known, alike)": "values " + ", ".join(f"({_q(a)}, {_q(b)}, {s!r}::double)" for a, b, s in _SPELLINGS),
    "gaps": "select g.*, m.confidence as sure, p.part_id, p.source, " + ", ".join(f"p.{f} as p_{f}" for f in ("manufacturer", "description", "package", "value", "tolerance", "voltage", "mpn"))
        + f", s.alike, {package('g.package')} as old_p, {package('p.package')} as new_p from v_gap_line g join matched m using (bom_id, source_row) join v_known_part p on p.part_id = m.part_id left join spellings s on s.given = g.manufacturer and s.known = p.manufacturer where m.confidence >= 70",
    "each_field": "select bom_id, source_row, source, unnest([" + ", ".join(f"{{'field': '{f}', 'old_value': {f}, 'new_value': {clean('p_' + f)}, 'confidence': ({s})::int}}" for f, s in {
        "manufacturer": "case when manufacturer = '' then sure when alike >= 82 then greatest(60, sure - 10) end", "description": "case when description = '' then sure end",
        "package": "case when package = '' then sure when p_package <> '' and old_p <> new_p and (new_p in ('', 'THT', 'SMD', 'SMT') or old_p in ('', 'THT', 'SMD', 'SMT') or least(length(old_p), length(new_p)) < 3) then greatest(55, sure - 20) end",
        "value": "case when value = '' and regexp_matches(p_value, '(nF|uH|R)$') then sure end", "tolerance": "case when tolerance = '' then sure end", "voltage": "case when voltage = '' then sure end",
        "mpn": f"case when mpn <> '' and mpn <> p_mpn and {mpn_key('mpn')} = {mpn_key('p_mpn')} then sure end",
    }.items()) + "], recursive := true) from gaps",
    "proposed": "select bom_id, source_row, field, old_value, new_value, source, confidence from each_field where confidence is not null and new_value <> '' and new_value <> old_value",
}
SQL |= {
    "completion_proposals": _with(_GAPS, "select * from proposed"),
    "completed_lines": _with(
        _GAPS | {"taken": "select bom_id, source_row, count(*)::int as filled, string_agg(field, ',' order by field) as fields, " + ", ".join(f"max(new_value) filter (field = '{f}') as n_{f}" for f in ("manufacturer", "description", "package", "value", "tolerance", "voltage", "mpn")) + " from proposed where confidence >= 80 group by all"},
        "select bom_id, source_row, " + ", ".join(f"coalesce(n_{f}, {f}) as {f}" for f in ("manufacturer", "description", "package", "value", "tolerance", "voltage", "mpn")) + ", coalesce(filled, 0) as filled, fields from v_gap_line left join taken using (bom_id, source_row)",
    ),
}


# Templates and columns that a user has set
_REPLAYED = _ALL | {
    "keyed": f"select sheet, score, list_sort(list_distinct(list_filter(list_transform(header, lambda h: {_KEY.format('h')}), lambda k: k <> ''))) as keys from regions",
    "layouts": "select *, substr(sha1(array_to_string(keys, '|')), 1, 16) as layout from keyed where len(keys) > 0",
    "saved": "select l.layout, m.field, m.col from (select layout, max(sheet) as sheet from layouts where sheet % 4 = 1 and sheet in (select sheet from mapping where field <> 'notes') group by layout) l join mapping m using (sheet) where m.field <> 'notes'",
    "fitting": "select r.sheet, s.field, s.col from regions r join layouts l using (sheet) join saved s using (layout) where s.col between 0 and len(r.header) - 1",
    "seeds": "select r.sheet, coalesce(list(f.col) filter (f.col is not null), []) as cols, coalesce(list(f.field) filter (f.col is not null), []) as fields from regions r left join fitting f using (sheet) group by r.sheet",
    "again": """select sheet, 0::bigint as place, cols, fields, null::int as col, null::varchar as field, null::double as score, null::int as tier from seeds
        union all select t.sheet, r.place, case when free then list_append(t.cols, r.col) else t.cols end, case when free then list_append(t.fields, r.field) else t.fields end, case when free then r.col end, r.field, r.score, r.tier
        from again t join ranked r on r.sheet = t.sheet and r.place = t.place + 1, lateral (select not list_contains(t.cols, r.col) and (r.field = 'alt_mpns' or not list_contains(t.fields, r.field)) as free)""",
    "replayed": "select sheet, col, field, score, tier from again where col is not null union all select sheet, col, field, 99.0::double, 0 from fitting",
}
SQL |= {
    "header_learning": _with(_LEARNED | {k: _MAPPING[k] for k in ("known_keys(key, field, hits)",)}, "select key, field, hits from known_keys"),
    "replayed_mapping": _recursive(
        _REPLAYED,
        """select sheet, col as "column", field, floor(score * 100 + 0.5)::bigint as hundredths, tier::int as tier from replayed where sheet % 5 <> 0 or (field not in ('notes', 'dnp') and col <> 0)
        union all select sheet, 0, 'notes', 10000, -1 from regions where sheet % 5 = 0""",
    ),
}


# Records in nested answers
_MARKED = "json_type(v) = 'OBJECT' and (" + " or ".join(f"{clean(f'json_extract_string(v, {_q(chr(36) + chr(46) + m)})')} <> ''" for m in C.RECORD_MARKERS) + ")"
_STATE = "case {0} when 'ROHS3 Compliant' then 'Compliant' when 'RoHS non-compliant' then 'Non-compliant' when 'Compliant by exemption' then 'Exempt' when 'No' then 'Non-compliant' when 'Yes' then 'Compliant' when 'No SVHC' then 'Compliant' else 'Unknown' end"
_fact = lambda name: f"coalesce(list_filter(specs, lambda s: s.name = '{name}')[1].value, '')"
SQL["payload_records"] = _recursive(
    {
        "parsed": "select part_id, payload::json as v from v_payload where json_valid(payload)",
        "walk": f"""select part_id, 0 as depth, v, []::varchar[] as path, {_MARKED} as found from parsed
            union all select part_id, depth, v, path, {_MARKED} from (select w.part_id, w.depth + 1 as depth, e.value as v, list_append(w.path, e.key::varchar) as path from walk w, json_each(w.v) e where not w.found and w.depth < 7 and json_type(w.v) in ('OBJECT', 'ARRAY'))""",
        "told": "select part_id, depth, path, coalesce(json_extract_string(v, '$.partNumber'), json_extract_string(v, '$.mpn'), json_extract_string(v, '$.manufacturerPartNumber')) as mpn, coalesce(from_json(json_extract(v, '$.specs'), '[{\"name\":\"VARCHAR\",\"value\":\"VARCHAR\"}]'), []) as specs from walk where found",
        "rated": "select *, list_filter(specs, lambda s: contains(lower(s.name), 'rohs')) as r, list_filter(specs, lambda s: contains(lower(s.name), 'reach')) as e from told",
        "chosen": f"select *, coalesce(list_filter(r, lambda s: {_STATE.format('s.value')} <> 'Unknown')[1], r[-1]).value as rv, coalesce(list_filter(e, lambda s: {_STATE.format('s.value')} <> 'Unknown')[1], e[-1]).value as ev from rated",
    },
    f"select part_id, depth, array_to_string(path, '/') as path, mpn, {_STATE.format('rv')} as rohs, coalesce(rv, '') as rohs_note, {_STATE.format('ev')} as reach, coalesce(ev, '') as reach_note, {_fact('MSL')} as msl, {_fact('Tariff Code')} as hts_code, {_fact('Country of Origin')} as country_of_origin from chosen",
)


# Staleness
_OBSERVED = "select user_id as part_id, case when event_type in ('view', 'click') then 'snapshot' else 'fact' end as kind, ts from events"
_LIFE = f"to_seconds({_case('kind', C.TIMES_TO_LIVE)})"
SQL |= {
    "stale_marks": f"select part_id, kind, stale_at from (select part_id, kind, ts + {_LIFE} as stale_at, lead(ts) over (partition by part_id, kind order by ts) as following from ({_OBSERVED})) where (following is null or following > stale_at) and stale_at < timestamp '2024-01-25'",
    "parts_to_fetch": _with(
        {"seen": f"select part_id, max(ts) filter (kind = 'fact') as fact, max(ts) filter (kind = 'snapshot') as snapshot from ({_OBSERVED}) where ts < timestamp '2024-01-20' group by part_id",
         "judged": "select p.part_id, case when p.part_id % 17 = 0 then 'forced' when fact is null then 'never verified' when timestamp '2024-01-20' - fact > interval 24 hours then 'facts' when timestamp '2024-01-20' - snapshot > interval 15 minutes then 'snapshot' end as reason from v_part p left join seen s on s.part_id = p.part_id"},
        "select part_id, reason from judged where reason is not null",
    ),
}

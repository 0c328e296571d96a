"""SQL for the registered queries, for an engine that knows the driver's tables only."""

from __future__ import annotations

from partloom import constants as C
from partloom.operators.lines import RULES as _RULES  # noqa: F401  the rules below are its counterpart
from partloom.sources.views import with_views


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _in(xs) -> str:
    return "(" + ", ".join(map(_q, xs)) + ")"


def _case(x: str, m: dict) -> str:
    return f"case {x} " + " ".join(f"when {_q(k)} then {v if isinstance(v, (int, float)) else _q(v)}" for k, v in m.items()) + " end"


def clean(x: str) -> str:
    t = rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"
    return f"(case when lower({t}) in {_in(C.NULL_TOKENS)} then '' else {t} end)"


def mpn_key(x: str) -> str:
    return rf"regexp_replace(regexp_replace(upper({clean(x)}), '[(\[{{].*?[)\]}}]', '', 'g'), '[^A-Z0-9]+', '', 'g')"


_SUFFIX = "|".join(sorted(C.PACKAGING_SUFFIXES, key=len, reverse=True))


def root(x: str) -> str:
    return rf"regexp_replace(case when length({clean(x)}) < 4 then upper({clean(x)}) else regexp_extract(upper({clean(x)}), '^(.{{4,}}?)(?:{_SUFFIX})*$', 1) end, '^[-/_ .#]+|[-/_ .#]+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(upper({clean(x)}), '[^A-Z0-9]+'), lambda t: t <> '')"


def package(x: str) -> str:
    t = rf"regexp_replace(replace(regexp_replace(upper({clean(x)}), '^(FOOTPRINT|PKG|PACKAGE|LIB|SM|SMD|SMT)[_\-: ]+', ''), '_', '-'), '^[- ]+|[- ]+$', '', 'g')"
    bare = f"regexp_replace({t}, '[^A-Z0-9]', '', 'g')"
    lead = rf"regexp_extract({t}, '^(\d{{4,5}})\b', 1)"
    imperial = _in(C.METRIC_CHIPS.values())
    ipc = rf"regexp_extract({t}, '^(RES|CAP|IND|DIO|LED)[CM]?(\d{{4}})[XN]?', 2)"
    return f"coalesce({_case(ipc, C.METRIC_CHIPS)}, case when {bare} in {imperial} then {bare} end, case when ends_with({bare}, 'M') then {_case(f'left({bare}, length({bare}) - 1)', C.METRIC_CHIPS)} end, {_case(bare, C.METRIC_CHIPS)}, {_case(bare, C.PACKAGE_ALIASES)}, case when {lead} in {imperial} then {lead} end, {_case(lead, C.METRIC_CHIPS)}, {t})"


_LEAD = "case part_id % 4 when 0 then part_id % 30 * 7 when 1 then 0 when 2 then null else part_id % 90 + 5 end"
#: The fixture's designators are one range each: letter, low, letter, high.
_REFS = r"select bom_id, source_row, mpn, substr(ref_text, 1, 1) as letter, regexp_extract(ref_text, '^[A-Z]+(\d+)', 1)::int as low, regexp_extract(ref_text, '(\d+)$', 1)::int as high from v_bom_line"
_EACH_REF = f"select bom_id, source_row, mpn, letter, low, unnest(range(low, high + 1)) as n from ({_REFS})"

_RATE = _case("o.currency", C.FX_CENTS)
_USABLE = """select * from (select *, max(stock > 0) over (partition by part_id) as any_stock from (
    select *, max(authorized) over (partition by part_id) as allowed from v_offer) where authorized or not allowed) where stock > 0 or not any_stock"""


def _usd(x: str, rate: str = _RATE) -> str:
    return f"cast(({x} * 200 + {rate}) // ({rate} * 2) as bigint)"


def _options(wanted: str) -> str:
    """part_id, required and a priced option for each offer; wanted: distinct part_id, required."""
    order = "((greatest(w.required, o.moq) + o.spq - 1) // o.spq * o.spq)"
    return f"""select w.part_id, w.required, o.supp_id, o.stock, {order}::bigint as order_qty, {_usd("b.unit_micro")} as unit_micro,
        ({_usd("b.unit_micro")} * {order})::bigint as extended_micro, o.stock >= {order} as covers, ({order} - w.required)::bigint as overbuy,
        case when o.stock > 0 then 0 else o.factory_lead_days end as lead_days
        from ({wanted}) w join ({_USABLE}) o on o.part_id = w.part_id
        join v_price_break b on b.part_id = o.part_id and b.supp_id = o.supp_id
         and b.break_qty = case when {order} >= 10000 then 10000 when {order} >= 1000 then 1000 when {order} >= 100 then 100 when {order} >= 10 then 10 else 1 end"""


_BEST = """select part_id, required, arg_min(supp_id, k) as supp_id, arg_min(order_qty, k) as order_qty, arg_min(unit_micro, k) as unit_micro, arg_min(extended_micro, k) as extended_micro,
    arg_min(covers, k) as covers, arg_min(overbuy, k) as overbuy, count(*) as options,
    (coalesce(max(case when covers then unit_micro end), max(unit_micro)) - coalesce(min(case when covers then unit_micro end), min(unit_micro))) * greatest(required, 1) as savings_micro,
    coalesce(max(case when covers then unit_micro end), max(unit_micro)) as high, coalesce(min(case when covers then unit_micro end), min(unit_micro)) as low
    from (select *, (not covers, extended_micro, lead_days, supp_id) as k from options) group by part_id, required"""
_WANTED = "select bom_id, source_row, part_id, input_unit_micro, (quantity * 100)::bigint as required from v_bom_line where not dnp and quantity > 0"


def _with(ctes: dict[str, str], final: str) -> str:
    """A query with its own CTEs after the views it needs."""
    whole = with_views(" ".join([*ctes.values(), final]))
    head = whole[: whole.rindex(" ".join([*ctes.values(), final]))]
    own = ", ".join(f"{k} as ({v})" for k, v in ctes.items())
    return (head.rstrip() + ", " if head else "with ") + own + " " + final


def _costed(final: str) -> str:
    ctes = {"wanted": _WANTED, "options": _options("select distinct part_id, required from wanted"), "best": _BEST, "costs": "select w.*, b.* exclude (part_id, required) from wanted w left join best b using (part_id, required)"}
    return _with(ctes, final)


_EXPECTED = "case " + " ".join(rf"when regexp_matches(description || ' ' || value_text, '(?i)\b({w})\b') then {_list(p)}" for w, p in C.TYPE_PREFIXES) + " end"


def _issues(source: str, more: str = "") -> str:
    """bom_id, source_row, i: every broken rule of the lines of source; more: rules on columns that only some lines have."""
    flag = lambda cond, code, severity: f"case when {cond} then {{'code': '{code}', 'severity': {severity if severity.startswith('case') else _q(severity)}}} end"
    usual = r"tidy <> '' and not excel and not science"
    found = [
        flag("tidy <> '' and excel", "mpn_excel_error", "error"), flag("science", "mpn_scientific", "error"), flag(rf"{usual} and regexp_matches(mpn, '^[\d\s.,\-]+$') and length(tidy) < 5", "mpn_numeric", "warning"),
        flag(f"{usual} and length(tidy) < 3", "mpn_too_short", "warning"), flag(f"{usual} and length(tidy) > 60", "mpn_too_long", "warning"), flag(f"{usual} and (contains(mpn, '  ') or mpn <> trim(mpn))", "mpn_whitespace", "info"),
        flag(f"{usual} and regexp_matches(mpn, '[À-ɏ一-鿿]')", "mpn_non_ascii", "warning"),
        flag("not dnp and quantity < 0", "qty_negative", "error"), flag("not dnp and quantity = 0", "qty_zero", "warning"),
        flag("not dnp and quantity > 0 and quantity <> floor(quantity)", "qty_fractional", "case when n = 0 or len(list_filter(refs, lambda r: not regexp_matches(r, '^[A-Z]{1,4}[0-9]{1,6}[A-Z]?$'))) > 0 then 'info' else 'warning' end"),
        flag("not dnp and quantity > 100000", "qty_implausible", "warning"), flag("not dnp and manufacturer = '' and mpn <> ''", "manufacturer_missing", "info"), flag("manufacturer <> '' and length(trim(manufacturer)) < 2", "manufacturer_short", "warning"),
        flag("len(list_filter(refs, lambda r: not regexp_matches(r, '^[A-Z]{1,4}[0-9]{1,6}[A-Z]?$'))) > 0", "refdes_malformed", "info"), flag("len(list_distinct(prefixes)) > 1", "refdes_mixed_prefix", "warning"),
        flag("len(prefixes) > 0 and expected is not null and not list_has_any(prefixes, expected)", "refdes_prefix_mismatch", "info"),
        flag("not dnp and n > 0 and quantity <> n and quantity > 0 and quantity % n = 0", "refdes_quantity_multiple", "info"), flag("not dnp and n > 0 and quantity <> n and (quantity <= 0 or quantity % n <> 0)", "refdes_quantity_mismatch", "warning"),
        flag("package <> '' and length(trim(package)) < 2", "package_unparsed", "info"), flag("dnp and input_unit_micro > 0", "dnp_with_price", "info"),
    ]
    return rf"""select bom_id, source_row, unnest([{", ".join(found)}{more}]) as i from (
        select *, len(refs) as n, list_filter(list_transform(refs, lambda r: regexp_extract(r, '^([A-Z]{{1,4}})[0-9]{{1,6}}[A-Z]?$', 1)), lambda p: p <> '') as prefixes, {_EXPECTED} as expected,
        {clean("mpn")} as tidy, regexp_matches(mpn, '(?i)^#(DIV/0!|NULL!|NUM!)$') as excel, regexp_matches(mpn, '(?i)^\d(\.\d+)?E[+\-]?\d+$') as science from (
        select *, case when ref_text = '' then []::varchar[] when contains(ref_text, '-') then list_transform(range(regexp_extract(ref_text, '^[A-Z]+(\d+)', 1)::int, regexp_extract(ref_text, '(\d+)$', 1)::int + 1), lambda k: substr(ref_text, 1, 1) || k) else string_split(ref_text, ',') end as refs from {source}))"""


_ISSUES = _issues("v_bom_line")
#: The fixture's descriptions hold 10k or 100nF; values that end alike differ by less than a thousand times.
_ODD_ISSUES = _issues("v_odd_line", rf""", case when (description like 'RES 10k%' and regexp_matches(value_text, '^\d+k$') and value_text <> '10k') or (description = 'CAP CER 100nF' and regexp_matches(value_text, '^\d+nF$') and value_text <> '100nF') then {{'code': 'value_description_mismatch', 'severity': 'warning'}} end,
    case when tolerance = 'odd' then {{'code': 'tolerance_unparsed', 'severity': 'info'}} end, case when {mpn_key('alt_text')} = {mpn_key('mpn')} then {{'code': 'alt_equals_primary', 'severity': 'info'}} end, case when alt_text = 'ab' and {mpn_key('mpn')} <> 'AB' then {{'code': 'alt_too_short', 'severity': 'info'}} end""")


def _bom_issues(source: str) -> str:
    return f"""select bom_id, i.code as code, i.severity as severity from (select bom_id, unnest([
        case when no_mpn * 100 > live * 50 then {{'code': 'mpn_coverage_low', 'severity': 'error'}} end, case when no_mpn * 100 > live * 15 and no_mpn * 100 <= live * 50 then {{'code': 'mpn_coverage_partial', 'severity': 'warning'}} end,
        case when n <= 2 then {{'code': 'bom_very_small', 'severity': 'warning'}} end, case when n_dnp * 100 > n * 30 then {{'code': 'dnp_share_high', 'severity': 'info'}} end]) as i
        from (select bom_id, count(*) as n, count(*) filter (not dnp) as live, count(*) filter (mpn = '' and not dnp) as no_mpn, count(*) filter (dnp) as n_dnp from {source} group by bom_id)) where i is not null"""


_PARTS = f"select *, {mpn_key('mpn')} as mpn_key, {mpn_key(root('mpn'))} as root_key, {package('package')} as package_key from v_part"


def _matched(lines: str, parts: str) -> dict[str, str]:
    """The parts that share the line's number, else its root; of the better tier the smallest id."""
    generic = "('THT', 'SMD', 'SMT')"
    same = f"case when l.package_key = '' or p.package_key = '' or l.package_key in {generic} or p.package_key in {generic} then 0 when l.package_key = p.package_key then 6 when least(length(l.package_key), length(p.package_key)) < 3 then 0 else -13 end"
    maker = lambda agreed: f"case when l.maker = '' and p.maker = '' then 0 when p.maker = '' then -2 when l.maker = '' then 1 when l.maker = p.maker then {agreed} else -28 end"
    key = "regexp_replace(upper(manufacturer), '[^A-Z0-9]+', '', 'g')"
    return {
        "keyed_lines": f"select *, {mpn_key('mpn')} as mpn_key, {mpn_key(root('mpn'))} as root_key, {key} as maker, {package('package')} as package_key from ({lines})",
        "keyed_parts": f"select part_id, {mpn_key('mpn')} as mpn_key, {mpn_key(root('mpn'))} as root_key, {key} as maker, {package('package')} as package_key, part_id in (select part_id from v_offer) as offered from ({parts})",
        "met": f"""select bom_id, source_row, part_id, tier, sure from (
            select l.bom_id, l.source_row, p.part_id, case when l.maker = p.maker and l.maker <> '' then 0 else 1 end as tier, case when l.maker = p.maker and l.maker <> '' then 100 else 92 end + {maker('0')} + {same} + case when p.offered then 0 else -4 end as sure from keyed_lines l join keyed_parts p on l.mpn_key = p.mpn_key where l.mpn_key <> ''
            union all select l.bom_id, l.source_row, p.part_id, 2 as tier, 82 + {maker('4')} + {same} + case when p.offered then 0 else -4 end as sure from keyed_lines l join keyed_parts p on l.root_key = p.root_key where length(l.root_key) >= 5)""",
        "ranked": "select *, row_number() over (partition by bom_id, source_row order by tier, part_id) as r from met",
        "matched": "select l.bom_id, l.source_row, r.part_id, case r.tier when 0 then 'exact_with_maker' when 1 then 'exact' when 2 then 'root' else 'none' end as kind, coalesce(least(greatest(r.sure, 0), 100), 0)::int as confidence from keyed_lines l left join ranked r on r.bom_id = l.bom_id and r.source_row = l.source_row and r.r = 1",
    }


_SUPPLY = """select part_id, sum(stock)::bigint as stock, count(distinct supp_id) as listed, count(distinct case when stock > 0 then supp_id end) as stocking,
    count(distinct case when authorized then supp_id end) as authorized_listed, count(distinct case when stock > 0 and authorized then supp_id end) as authorized_stocking, min(case when stock > 0 then 0 else factory_lead_days end) as lead_days from v_offer group by part_id"""


def _scored(final: str) -> str:
    w = C.WEIGHTS
    total = " + ".join(f"f_{k} * {v!r}" for k, v in w.items())
    ctes = _matched("select * from v_bom_line", "select * from v_part")
    ctes |= {
        "issues": f"select bom_id, source_row, count(*) filter (i.severity = 'error') as errors, count(*) filter (i.severity = 'warning') as warnings from ({_ISSUES}) where i is not null group by all",
        "supply": _SUPPLY,
        "flat": """select l.bom_id, l.source_row, l.dnp, l.quantity, m.part_id, m.kind, m.confidence, coalesce(i.errors, 0) as errors, coalesce(i.warnings, 0) as warnings,
            case when l.dnp then 0 else (l.quantity * 100)::bigint end as required, p.lifecycle, p.rohs, p.reach, p.eccn, coalesce(s.stock, 0) as stock, coalesce(s.listed, 0) as listed, coalesce(s.stocking, 0) as stocking,
            coalesce(s.authorized_listed, 0) as authorized_listed, coalesce(s.authorized_stocking, 0) as authorized_stocking, s.lead_days
            from v_bom_line l join matched m using (bom_id, source_row) left join issues i using (bom_id, source_row) left join v_part p on p.part_id = m.part_id left join supply s on s.part_id = m.part_id""",
        "options": _options("select distinct part_id, required from flat where required > 0 and part_id is not null"),
        "best": _BEST,
        "lines": "select f.*, b.unit_micro, b.covers, b.overbuy, b.low, b.high from flat f left join best b using (part_id, required)",
        "deep": """select *, case when stock * 100 >= required * 110 * 10 then 0 when stock * 100 >= required * 110 * 3 then 8 when stock * 200 >= required * 110 * 3 then 20 when stock * 100 >= required * 110 then 38
            when stock * 200 >= required * 110 then 62 else 85 end::double as base,
            case when authorized_listed = 0 then 100.0::double when authorized_stocking = 0 then 82 when authorized_stocking = 1 then 58 when authorized_stocking = 2 then 18 else greatest(0.0::double, 14 - 2.5::double * (authorized_stocking - 2)) end as wide,
            (case rohs when 'Non-compliant' then 85 when 'Exempt' then 20 when 'Unknown' then 35 else 0 end + case reach when 'Non-compliant' then 22 else 0 end + case when eccn <> 'EAR99' then 35 else 0 end) as law from lines""",
        "factors": """select *, case when lifecycle is null then 55.0::double else case lifecycle when 'Active' then 0 when 'New' then 8 when 'Unknown' then 35 when 'NRND' then 69 when 'EOL' then 92 else 100 end::double end as f_lifecycle,
            case when lifecycle is null then 55.0::double when stock <= 0 then 100 when stocking >= 3 then base * 0.8::double when stocking = 1 then least(base + 8, 100) else base end as f_availability,
            case when lifecycle is null then 55.0::double when authorized_stocking = 0 and stocking > 0 then least(wide + 8, 100) else wide end as f_sourcing,
            case when lifecycle is null then 45.0::double when lead_days is null then 50 when lead_days <= 0 then 0 when lead_days >= 168 then 100 when lead_days >= 84 then 55 + 45 * (lead_days - 84)::double / 84 else (55 * lead_days)::double / 84 end as f_lead_time,
            case when lifecycle is null then 40.0::double else least(law, 100)::double end as f_compliance,
            least(case when kind = 'none' then 100.0::double else least(85.0::double, 1.6::double * greatest(90 - confidence, 0)) end + 22 * errors + 7 * warnings, 100.0::double) as f_data_quality,
            least(case when unit_micro is null then 60.0::double else case when high - low > 2 * low then 55 when (high - low) * 10 > 8 * low then 30 when (high - low) * 10 > 3 * low then 12 else 0 end + case when overbuy > 2 * required then 30 when overbuy * 2 > required then 15 else 0 end + case when not covers then 40 else 0 end end, 100.0::double) as f_cost from deep""",
        "raw": f"select *, ({total.replace(' * 1.0', ' * 1.0::double').replace(' * 0.', ' * 0.')}) / {sum(w.values())!r}::double as mean, greatest({', '.join(f'f_{k}' for k in w)}) as grave from factors".replace("* 0.8", "* 0.8::double").replace("* 0.7", "* 0.7::double").replace("* 0.6", "* 0.6::double").replace("* 0.5", "* 0.5::double").replace("* 0.4", "* 0.4::double"),
        "raised": """select *, case when grave >= 95 and (f_lifecycle = grave or f_availability = grave or f_sourcing = grave or (f_compliance = grave and f_lead_time < grave)) then greatest(mean, 72) when grave >= 85 and (f_lifecycle = grave or f_availability = grave) then greatest(mean, 55) else mean end as upper_score,
            case when lifecycle = 'NRND' then 30 when lifecycle = 'EOL' then 52 when lifecycle = 'Obsolete' then 72 when lifecycle = 'Unknown' and kind <> 'none' then 25 when lifecycle is null then 45 else 0 end as least_score from raw""",
        "final_scores": "select *, case when dnp then 0.0::double else greatest(upper_score, least_score::double) end as x from raised",
        "scored": "select *, floor(x * 10 + 0.5::double) / 10 as score, case when x >= 75 then 'critical' when x >= 50 then 'high' when x >= 25 then 'medium' else 'low' end as level from final_scores",
    }
    return _with(ctes, final)


_F = ", ".join(f"f_{k} as {k}" for k in C.WEIGHTS)
_MEANS = ", ".join(f"floor((100 - sum(floor(f_{k} * 1000 + 0.5::double) / 1000 * w) / sum(w)) * 10 + 0.5::double) / 10 as {k}" for k in C.WEIGHTS if k != "cost")
_HEALTH = " + ".join(f"{k} * {v!r}::double" for k, v in C.WEIGHTS.items() if k != "cost")
_HEALTH_WEIGHT = sum(v for k, v in C.WEIGHTS.items() if k != "cost")
_FLAGS = """array_to_string(list_filter([case when dnp then 'DNP' end, case when lifecycle in ('NRND', 'EOL', 'Obsolete') then lifecycle end, case when authorized_listed = 0 and stock > 0 then 'Broker only' end, case when lifecycle = 'Unknown' then 'Lifecycle unknown' end, case when stock <= 0 then 'No stock' end,
    case when stock > 0 and stocking = 1 then 'Single source' end, case when lead_days >= 84 then 'Long lead' end, case when rohs = 'Non-compliant' then 'Not RoHS' end, case when rohs = 'Exempt' then 'RoHS exempt' end, case when reach = 'Non-compliant' then 'REACH SVHC' end,
    case when eccn <> 'EAR99' then 'Export controlled' end, case when kind = 'none' then 'No data' end, case when kind <> 'none' and confidence < 90 then 'Review match' end, case when errors > 0 then 'Data error' end, case when overbuy * 2 > required then 'MOQ overbuy' end], lambda f: f is not null), '|')"""
_DRIVER = "case " + " ".join(f"when f_{k} = grave then '{k}'" for k in C.WEIGHTS) + " end"
_ROWS = {"source_row % 3": f"select * replace (case when source_row % 3 = 0 then {root('mpn')} else mpn end as mpn) from v_bom_line"}

SQL: dict[str, str] = {
    "text_keys": f"select item_id, regexp_replace(upper({clean('text')}), '[^A-Z0-9]+', '', 'g') as slug, regexp_replace(lower({clean('text')}), '[^a-z0-9]+', '', 'g') as header_key, len({tokens('text')})::int as n_tokens, array_to_string({tokens('text')}, ' ') as tokens, case when length({clean('text')}) > 40 then rtrim(substr({clean('text')}, 1, 39)) || '…' else {clean('text')} end as short, case when regexp_matches(text, '^[=+\\-@\\t\\r]') then '''' || text else text end as safe from (select item_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') as text from benchmark)",
    "mpn_keys": with_views(f"select part_id, {mpn_key('mpn')} as mpn_key, {root('mpn')} as root from v_part"),
    "package_names": with_views(f"select part_id, {package('package')} as package_key, case when {package('package')} in ('', 'THT') then null else {package('package')} = '0603' end as is_0603 from v_part"),
    "cell_parsing": with_views(f"select part_id, (1000 + part_id % 1000)::double as quantity, case part_id % 3 when 0 then (part_id % 10)::double when 1 then 1.0 else 10.0 end::double as tolerance, ({_LEAD})::int as lead_days, case when {_LEAD} is null then '' when {_LEAD} <= 0 then 'In stock' when {_LEAD} < 14 then ({_LEAD})::varchar || ' d' when {_LEAD} < 120 then round_even(({_LEAD}) / 7.0, 0)::int::varchar || ' wk' else round_even(({_LEAD}) / 30.0, 0)::int::varchar || ' mo' end as lead_text from v_part"),
    "states_of_wording": with_views("select part_id, case part_id % 5 when 0 then 'NRND' when 1 then 'EOL' when 2 then 'Obsolete' when 3 then 'Active' else 'Unknown' end as lifecycle, case part_id % 4 when 0 then 'Compliant' when 1 then 'Non-compliant' when 2 then 'Exempt' else 'Compliant' end as rohs from v_part"),
    "refdes_expand": with_views(f"select bom_id, source_row, (n - low)::int as pos, letter || n as ref from ({_EACH_REF})"),
    "refdes_collapse": _with(
        {"runs": f"select bom_id, letter, min(n) as low, max(n) as high from (select *, n - row_number() over (partition by bom_id, letter order by n) as island from (select distinct bom_id, letter, n from ({_EACH_REF}))) group by bom_id, letter, island"},
        "select bom_id, string_agg(case when high - low >= 2 then letter || low || '-' || letter || high when high > low then letter || low || ', ' || letter || high else letter || low end, ', ' order by letter, low) as collapsed from runs group by bom_id",
    ),
    "refdes_conflicts": _with(
        {"shared": f"select bom_id, letter || n as ref, count(distinct {mpn_key('mpn')}) as parts, list_sort(list(distinct source_row)) as rows from ({_EACH_REF}) group by all"},
        "select bom_id, array_to_string(rows, ',') as signature, min(ref) as ref, arg_min(parts, ref) as parts from shared where parts > 1 and len(rows) > 1 group by bom_id, rows",
    ),
    "near_duplicate_mpn": _with(
        {"typed": f"select bom_id, case when source_row % 2 = 0 then {root('mpn')} else mpn end as mpn from v_bom_line"},
        f"select bom_id, root_key, count(distinct mpn_key) as spellings, count(*) as lines from (select bom_id, {mpn_key('mpn')} as mpn_key, {mpn_key(root('mpn'))} as root_key from typed) where length(root_key) >= 5 group by all having count(distinct mpn_key) >= 2",
    ),
    "merge_duplicates": _with(
        {
            "keyed": f"select *, case when {mpn_key('mpn')} <> '' then 'MPN:' || {mpn_key('mpn')} || ':' || regexp_replace(upper(manufacturer), '[^A-Z0-9]+', '', 'g') || ':' || case when dnp then 'DNP' else 'FIT' end else 'ROW:' || source_row end as k from v_bom_line",
            "filled": "select *, (mpn <> '')::int + (manufacturer <> '')::int + (description <> '')::int + (package <> '')::int + (value_text <> '')::int as n from keyed",
            "merged": "select bom_id, k, min(source_row) as source_row, sum(quantity) as quantity, count(*) as merged, first(dnp) as dnp, coalesce(arg_max(mpn, (n, -source_row)) filter (mpn <> ''), '') as mpn, coalesce(arg_max(manufacturer, (n, -source_row)) filter (manufacturer <> ''), '') as manufacturer, coalesce(arg_max(package, (n, -source_row)) filter (package <> ''), '') as package from filled group by bom_id, k",
            "refs": f"select bom_id, k, string_agg(ref, ',' order by ref) as designators from (select distinct bom_id, k, letter || n as ref from ({_EACH_REF}) join (select bom_id, source_row, k from keyed) using (bom_id, source_row)) group by all",
        },
        "select bom_id, row_number() over (partition by bom_id order by source_row)::int as line_no, source_row, quantity, merged, dnp, mpn, manufacturer, package, designators from merged join refs using (bom_id, k)",
    ),
    "line_rules": with_views(f"select bom_id, source_row, i.code as code, i.severity as severity from ({_ISSUES}) where i is not null"),
    "bom_rules": with_views(_bom_issues("v_bom_line")),
    "odd_line_rules": with_views(f"select bom_id, source_row, i.code as code, i.severity as severity from ({_ODD_ISSUES}) where i is not null"),
    "odd_bom_rules": with_views(_bom_issues("v_odd_line")),
    "issue_counts": with_views(f"select bom_id, i.severity as severity, count(*) as n from ({_ISSUES}) where i is not null group by all"),
    "line_summary": with_views(f"select bom_id, count(*) as lines, count(*) filter (mpn <> '') as with_mpn, count(*) filter (manufacturer <> '') as with_manufacturer, count(*) filter (dnp) as dnp_lines, sum(case when dnp then 0 else greatest(0, quantity) end)::bigint as placements, count(distinct {mpn_key('mpn')}) as unique_parts from v_bom_line group by bom_id"),
    "dnp_lines": with_views("select bom_id, source_row from v_bom_line where dnp or source_row % 7 = 0 or source_row % 5 = 0"),
    "provider_merge": with_views(f"""select part_id, {", ".join(f"coalesce(arg_min({c}, (-offer_count, provider)) filter ({c} <> ''), '') as {c}" for c in ("mpn", "manufacturer", "description", "package"))},
        arg_max(lifecycle, {_case("lifecycle", C.LIFECYCLE_RANK)}) as lifecycle, arg_max(rohs, {_case("rohs", C.COMPLIANCE_RANK)}) as rohs, arg_max(reach, {_case("reach", C.COMPLIANCE_RANK)}) as reach, sum(offer_count)::bigint as offers, count(*) as sources from v_provider_part group by part_id"""),
    "offer_dedupe": with_views("select part_id, distributor, arg_max(supp_id, (stock, -supp_id)) as supp_id, max(stock) as stock, arg_max(moq, (stock, -supp_id)) as moq from v_offer group by part_id, distributor"),
    "part_supply": with_views(_SUPPLY),
    "price_at_quantity": with_views("select part_id, supp_id, max(break_qty)::bigint as break_qty, arg_max(unit_micro, break_qty) as unit_micro from v_price_break where break_qty <= greatest((part_id * 37 + supp_id) % 3000, 1) group by part_id, supp_id"),
    "order_quantities": with_views("select part_id, supp_id, ((greatest(part_id % 500 + 1, moq) + spq - 1) // spq * spq)::bigint as order_qty, ceil((moq / 8)::decimal(18,6) * 100)::bigint as required from v_offer"),
    "fx_convert": with_views(f"select part_id, supp_id, break_qty, {_usd('unit_micro')} as usd_micro from v_price_break join v_offer o using (part_id, supp_id)"),
    "line_match": _with(_matched(_ROWS["source_row % 3"], "select * replace (case when part_id % 50 = 0 then mpn || 'Z9' else mpn end as mpn) from v_part"), "select * from matched"),
    "match_summary": _with(_matched("select * from v_bom_line", "select * from v_part"), "select bom_id, count(*) as lines, count(*) filter (kind <> 'none') as matched, count(*) filter (kind = 'none') as unmatched, count(*) filter (kind <> 'none' and confidence < 90) as needs_review, sum(confidence) filter (kind <> 'none')::bigint as confidence_sum from matched group by bom_id"),
    "line_cost": _costed("select bom_id, source_row, required, supp_id, order_qty, unit_micro, extended_micro, covers, overbuy, options, savings_micro from costs"),
    "bom_cost_rollup": _costed("""select *, ((costed * 2000 + costed + uncosted) // ((costed + uncosted) * 2))::bigint as coverage_permille, ((total_cents * 2 + 100) // 200)::bigint as per_unit_cents from (
        select bom_id, sum((extended_micro + 5000) // 10000)::bigint as total_cents, sum((savings_micro + 5000) // 10000)::bigint as savings_cents, count(extended_micro) as costed, count(*) filter (extended_micro is null) as uncosted, count(*) filter (not covers) as short_lines from costs group by bom_id)"""),
    "price_comparison": _costed("select bom_id, sum(input_unit_micro * required)::bigint as input_micro, sum(unit_micro * required)::bigint as market_micro, count(*) filter (abs(unit_micro - input_unit_micro) * 10 >= input_unit_micro) as movers, count(*) as compared from costs where unit_micro is not null and input_unit_micro > 0 group by bom_id"),
    "price_curve": _with({"options": _options("select part_id, q::bigint as required from v_part cross join (values (1), (10), (100), (1000), (10000)) as qs(q)")}, "select part_id, required, min(extended_micro // required)::bigint as each_micro, arg_min(supp_id, (extended_micro // required, supp_id)) as supp_id from options group by part_id, required"),
    "split_basket": _with(
        {
            "wanted": _WANTED, "options": _options("select distinct part_id, required from wanted"),
            "running": "select *, sum(stock) over w - stock as before, max(covers) over (partition by part_id, required) as covered from options window w as (partition by part_id, required order by unit_micro, supp_id rows between unbounded preceding and current row)",
        },
        "select part_id, required, count(*) filter (least(stock, required - before) > 0) as legs, sum(greatest(least(stock, required - before), 0) * unit_micro)::bigint as extended_micro from running where not covered group by part_id, required having sum(stock) >= required and count(*) filter (least(stock, required - before) > 0) >= 2",
    ),
    "line_risk": _scored(f"select bom_id, source_row, part_id, kind, {_F}, score, level from scored"),
    "risk_factors": _scored("select bom_id, code, count(*) filter (v >= 60) as warnings, count(*) filter (v >= 85) as errors from (" + " union all ".join(f"select bom_id, '{k}' as code, f_{k} as v from scored" for k in C.WEIGHTS) + ") group by all"),
    "risk_flags": _scored(f"select bom_id, source_row, {_FLAGS} as flags from scored"),
    "top_risks": _scored(f"select bom_id, place::int as place, source_row, score, driver from (select *, {_DRIVER} as driver, row_number() over (partition by bom_id order by score desc, quantity desc, source_row) as place from scored where not dnp and score > 0) where place <= 10"),
    "bom_health": _scored(f"""select * exclude (x), floor(x * 10 + 0.5::double) / 10 as score, case when x >= 92 then 'A+' when x >= 85 then 'A' when x >= 78 then 'B+' when x >= 70 then 'B' when x >= 62 then 'C+' when x >= 54 then 'C' when x >= 45 then 'D' else 'E' end as grade from (
        select *, greatest(0.0::double, ({_HEALTH}) / {_HEALTH_WEIGHT!r}::double - (least(18.0::double, 4 * obsolete) + least(15.0::double, 2 * no_stock) + least(20.0::double, 40.0::double * unmatched / lines) + least(12.0::double, 3 * non_rohs))) as x from (
        select bom_id, {_MEANS}, count(*) as lines, count(*) filter (lifecycle = 'Obsolete') as obsolete, count(*) filter (lifecycle is not null and stock <= 0) as no_stock, count(*) filter (kind = 'none') as unmatched, count(*) filter (rohs = 'Non-compliant') as non_rohs
        from (select *, greatest(1.0::double, quantity) as w from scored where not dnp) group by bom_id))"""),
    "distribution_counters": _scored("select bom_id, 'lifecycle' as counter, coalesce(lifecycle, 'No data') as bucket, count(*) as n from scored group by all union all select bom_id, 'level', level, count(*) from scored group by all union all select bom_id, 'rohs', coalesce(rohs, 'Unknown'), count(*) from scored group by all"),
    "compliance_summary": _scored(f"select bom_id, count(*) as lines, count(*) filter (rohs = 'Compliant') as rohs_ok, count(*) filter (rohs = 'Non-compliant') as rohs_fail, count(*) filter (reach = 'Non-compliant') as reach_fail, count(*) filter (eccn <> 'EAR99') as export, max({_case('rohs', C.COMPLIANCE_RANK)})::int as worst_rohs_rank from scored where not dnp group by bom_id"),
    "needs_alternates": _scored("select bom_id, source_row, part_id from scored where not dnp and lifecycle is not null and (lifecycle in ('NRND', 'EOL', 'Obsolete', 'Unknown') or stock <= 0 or stock < required or stocking < 2 or rohs = 'Non-compliant')"),
    "alternates_topk": _with(
        {
            "prepared": f"select p.*, coalesce(s.stock, 0) as stock, coalesce(s.stocking, 0) as stocking from ({_PARTS}) p left join ({_SUPPLY}) s using (part_id)",
            "pairs": """select a.part_id, b.part_id as candidate_id, 40 + 6 + 5 + 14
                + case b.lifecycle when 'Active' then case when a.lifecycle in ('NRND', 'EOL', 'Obsolete') then 22 else 16 end when 'New' then 12 when 'Unknown' then -4 else -30 end
                + case when b.stock <= 0 then -24 when b.stocking >= 2 then 10 else 4 end + case when a.package_key in ('', 'THT') then 0 else 18 end + case when a.manufacturer = b.manufacturer then 4 else 0 end
                + case b.rohs when 'Non-compliant' then -30 when 'Compliant' then 3 else 0 end + case when b.eccn <> 'EAR99' then -8 else 0 end
                + case when d <= -20 * m then 10 when d <= 5 * m then 5 when d <= 40 * m then -5 when d <= 100 * m then -14 when d <= 300 * m then -22 else -32 end as total
                from prepared a join prepared b on a.category = b.category and a.package_key = b.package_key and a.value_text = b.value_text and a.part_id <> b.part_id,
                lateral (select (b.median_1k_micro - a.median_1k_micro) * 100 as d, a.median_1k_micro as m)""",
            "ranked": "select *, least(greatest(total, 0), 100)::int as score, row_number() over (partition by part_id order by least(greatest(total, 0), 100) desc, candidate_id)::int as place from pairs",
        },
        "select part_id, place, candidate_id, score from ranked where place <= 5",
    ),
    "keyword_search": _with(
        {
            "typed": r"select item_id, concat_ws(' ', manufacturer, regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), description) as text from benchmark left join v_part on item_id = part_id",
            "asked": f"select distinct item_id, unnest({tokens('text')}) as word from typed",
            "told": f"""select distinct part_id, unnest({tokens("description || ' ' || manufacturer || ' ' || category")}) as word from v_part""",
        },
        "select item_id, part_id, shared, place from (select *, row_number() over (partition by item_id order by shared desc, part_id)::int as place from (select item_id, part_id, count(*) as shared from asked join told using (word) group by all)) where place <= 12",
    ),
    "snapshot_trend": with_views("""select part_id, supp_id, points, first_micro, last_micro, last_qty, change_permille, case when change_permille > 50 then 'up' when change_permille < -50 then 'down' else 'flat' end as direction from (
        select *, floor(((last_micro - first_micro) * 2000 + first_micro) / (first_micro * 2))::bigint as change_permille from (
        select part_id, supp_id, count(*) as points, arg_min(min_price_micro, (checked_at, min_price_micro, available_qty)) as first_micro, arg_max(min_price_micro, (checked_at, min_price_micro, available_qty)) as last_micro, arg_max(available_qty, (checked_at, min_price_micro, available_qty)) as last_qty from v_snapshot group by all))"""),
    "snapshot_series": with_views("select part_id, date_trunc('minute', checked_at) as minute, sum(available_qty)::bigint as stock, min(min_price_micro) as min_micro from v_snapshot group by all"),
    "part_dossier": with_views("select part_id, max(available) as available, sum(available_qty)::bigint as available_qty, min(min_price_micro) as min_micro, count(distinct supp_id) as distributors, max(checked_at) as latest from v_snapshot group by part_id"),
    "stale_parts": with_views("select part_id, max(checked_at) as latest from v_snapshot group by part_id having max(checked_at) < timestamp '2001-12-01' - interval 30 days"),
    "recent_parts": with_views("select part_id, max(checked_at) as latest from v_snapshot group by part_id order by latest desc, part_id limit 50"),
    "rate_limit_window": "select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as in_window from events",
    "lifecycle_fold": "select user_id, case max(case event_type when 'error' then 2 when 'purchase' then 3 else 0 end) when 3 then 'LAST_TIME_BUY' when 2 then 'EOL_ANNOUNCED' else 'ACTIVE' end as state, count(*) as events from events group by user_id",
    "event_sessions": "select user_id, session::bigint as session, min(ts) as started, max(ts) as ended, count(*) as events from (select *, sum(new) over (partition by user_id order by ts, event_id) as session from (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes then 0 else 1 end as new from events)) group by all",
    "events_per_minute": "select date_trunc('minute', ts) as minute, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as value_cents from events group by all",
    "column_profile": _with(
        {"cells": " union all ".join(f"select '{c}' as \"column\", {c} as cell from v_part" for c in ("mpn", "manufacturer", "description", "package", "value_text", "lifecycle"))},
        r"""select "column", count(*) as cells, count(distinct upper(cell)) as distinct_cells, ((count(*) filter (cell = '') * 2000 + count(*)) // (count(*) * 2))::bigint as blank, ((count(*) filter (regexp_matches(cell, '^\d+(\.\d+)?$')) * 2000 + count(*)) // (count(*) * 2))::bigint as numeric,
        ((count(*) filter (regexp_matches(cell, '^[A-Za-z0-9][A-Za-z0-9\-/.#+ ()]{3,}$') and regexp_matches(cell, '[0-9]') and regexp_matches(cell, '[A-Za-z]')) * 2000 + count(*)) // (count(*) * 2))::bigint as mpn_like,
        ((count(*) filter (regexp_matches(cell, '(?i)^\d+(\.\d+)?\s*(k|m|u|n|p)?(ohm|r|f|nf|uf|pf|h|uh)$')) * 2000 + count(*)) // (count(*) * 2))::bigint as value_like from cells group by "column" """,
    ),
    "header_fingerprint": "select user_id, substr(sha1(array_to_string(list_sort(list(distinct regexp_replace(lower(event_type), '[^a-z0-9]+', '', 'g'))), '|')), 1, 16) as fingerprint, count(distinct event_type)::int as headers from events group by user_id",
    "page_text_cells": r"select page_id, (pos - 1)::int as pos, trim(regexp_replace(cell, '<[^>]*>', ' ', 'g')) as cell from (select page_id, unnest(cells) as cell, generate_subscripts(cells, 1) as pos from (select page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) as cells from pages))",
}

_FACTS = ("mpn", "manufacturer", "description", "package", "lifecycle", "rohs", "reach")
_CLAIMS = """claims as (select *, provider::varchar as source, ['manufacturer', 'distributor', 'mock'][provider + 1] as source_type, case when provider = 0 then 900 when part_id % 6 = 0 then 450 else 700 end as confidence from v_provider_part),
 won as (select part_id, """ + ", ".join(f"min(provider) filter ({f} not in ('', 'Unknown') or ({f} = 'Unknown' and '{f}' <> 'lifecycle')) as p_{f}, arg_min({f}, provider) filter ({f} not in ('', 'Unknown') or ({f} = 'Unknown' and '{f}' <> 'lifecycle')) as w_{f}" for f in _FACTS) + """ from claims group by part_id),
 judged as (select c.*, """ + " + ".join(f"({f} <> '')::int" for f in _FACTS) + " as claimed, " + " + ".join(f"coalesce({f} <> '' and {f} <> w_{f}, false)::int" for f in _FACTS) + " as contested, " + " + ".join(f"coalesce({f} <> '' and {f} <> w_{f} and provider >= p_{f}, false)::int" for f in _FACTS) + """ as conflicts from claims c join won using (part_id))"""


def _with_more(ctes: str, sql: str) -> str:
    """The views that the query needs, its own tables after them, and the query."""
    made = with_views(f"{ctes} {sql}")
    return made.replace(f" {ctes} {sql}", f", {ctes} {sql}")


SQL |= {
    "fact_merge": _with_more(_CLAIMS, "select part_id, " + ", ".join(f"coalesce(any_value(w_{f}), '') as {f}" for f in _FACTS) + """, coalesce(any_value(p_lifecycle)::varchar, '') as lifecycle_source, sum(conflicts)::bigint as conflicts,
        ((2 * 85 * sum(confidence * [6, 3, 2][provider + 1]) + 100 * sum([6, 3, 2][provider + 1])) // (200 * sum([6, 3, 2][provider + 1])))::bigint as confidence from judged join won using (part_id) group by part_id"""),
    "fact_evidence": _with_more(_CLAIMS, """select part_id, source, claimed, contested, conflicts,
        case when claimed = 0 then 'unknown' when source_type = 'mock' then case when contested > 0 then 'unknown' else 'verified' end when contested > 0 then 'conflicting' when confidence >= 500 then 'verified' else 'unknown' end as status from judged"""),
    "source_offers": with_views(f"""select part_id, region, supp_id, available, (unit_micro * coalesce({_case('currency', C.DOSSIER_RATES)}, 10000) + 500000) // 1000000 * 100 as usd_micro from (
        select part_id, region, currency, coalesce(min(supp_id) filter (stock > 0), min(supp_id)) as supp_id, max(stock) > 0 as available from v_offer group by all) join v_price_break using (part_id, supp_id) where break_qty = 1"""),
    "part_risk": _with_more(
        f"""vendor as (select part_id, supp_id, count(*) as points, count(*) filter (checked_at >= timestamp '2000-06-01') as seen, coalesce(sum(available_qty) filter (available and checked_at >= timestamp '2000-06-01'), 0) as qty,
          bool_or(available and checked_at >= timestamp '2000-06-01') as held, first(min_price_micro order by checked_at, min_price_micro, available_qty) as a, last(min_price_micro order by checked_at, min_price_micro, available_qty) as z from v_snapshot group by all),
        told as (select vendor.*, case when points >= 2 then floor(((z - a) * 2000 + a)::double / (a * 2)) end as moved, case when stock <= 0 then (factory_lead_days * 200 + 7) // 14 end as weeks from vendor left join v_offer using (part_id, supp_id)),
        folded as (select part_id, sum(seen) as seen, sum(qty) as qty, count(*) filter (held) as vendors, sum(moved) as change, count(moved) as n_moved, sum(weeks * seen) as weeks, coalesce(sum(seen) filter (weeks is not null), 0) as timed from told group by part_id),
        shares as (select p.part_id, ({_case('lifecycle', C.DOSSIER_LIFECYCLE)})::bigint as lifecycle_risk,
          (case when seen > 0 then 1000 - least(1000, qty) when seen = 0 then 500 else 800 end)::bigint as stock_risk,
          (case when seen > 0 and timed > 0 then least(1000, (weeks * 2000 + timed * 5200) // (timed * 10400)) when seen > 0 then 800 when seen = 0 then 500 else 900 end)::bigint as lead_risk,
          (case when vendors >= 3 then 0 when vendors = 2 then 400 when vendors = 1 then 700 else 1000 end)::bigint as vendor_risk,
          (case when n_moved > 0 then case when change > n_moved * 50 then 900 else 200 end else 500 end)::bigint as trend_risk, (case when manufacturer = '' then 1000 else 0 end)::bigint as maker_risk
          from v_part p left join folded using (part_id)),
        rated as (select *, (lifecycle_risk * 40 + stock_risk * 20 + lead_risk * 15 + vendor_risk * 10 + trend_risk * 10 + maker_risk * 5 + 500) // 1000 as score from shares)""",
        "select *, case when score < 25 then 'LOW' when score < 50 then 'MEDIUM' when score < 75 then 'HIGH' else 'CRITICAL' end as level from rated",
    ),
    "replacements_topk": _with_more(
        f"""traits as (select p.part_id, upper(mpn) as mpn, lower(category) as category, regexp_replace(upper(package), '[- ]', '', 'g') as package, (p.part_id % 3)::int as v, ({_case('lifecycle', C.DOSSIER_LIFECYCLE)}) as risk, coalesce(s.n, 0) > 0 as available
          from v_part p left join (select part_id, sum(stock) as n from v_offer group by part_id) s using (part_id)),
        pairs as (select t.part_id, c.part_id as candidate_id, c.mpn, t.package = c.package as same, t.v = 0 or c.v = 0 or t.v = c.v or (t.v = 2 and c.v = 1) as volts, c.v as cv, t.v as tv, c.risk, c.available from traits t join traits c on t.category = c.category and t.mpn <> c.mpn),
        kinds as (select *, same and volts and (tv = 0 or cv <> 0) as drop_in, (least(100000, 50000 + same::int * 25000 + case when volts then 10000 else 3500 end + 20000 + (1000 - risk) * 5 + case when available then 5000 else 3000 end) + 50) // 100 as s0 from pairs),
        scores as (select *, case when drop_in and cv = 0 then (s0 * 8 + 5) // 10 else s0 end as s1 from kinds),
        finals as (select part_id, candidate_id, mpn, case when drop_in then 'DROP_IN' else 'FUNCTIONAL' end as kind, (case when risk > 0 then (s1 * (100000 - risk * 15) + 50000) // 100000 else s1 end)::bigint as score from scores)""",
        "select part_id, row_number() over (partition by part_id order by kind, score desc, mpn, candidate_id)::int as place, candidate_id, kind, score from finals qualify row_number() over (partition by part_id order by kind, score desc, mpn, candidate_id) <= 12",
    ),
    "quote_rows": _scored(f"select l.bom_id, l.source_row, l.mpn, l.manufacturer, s.required as quantity from scored s join v_bom_line l using (bom_id, source_row) where not l.dnp and {mpn_key('l.mpn')} <> ''"),
    "compliance_exceptions": _scored("select bom_id, source_row, part_id, rohs, reach, eccn from scored where coalesce(not (rohs = 'Compliant' and reach in ('Compliant', 'Unknown') and eccn = 'EAR99'), true)"),
}


def _known(x: str, m: dict) -> str:
    return "(" + _case(x, m) + ")"


def _aliases(m: dict) -> dict[str, str]:
    keyed: dict[str, str] = {}
    for name, spellings in m.items():
        for s in (name, *spellings):
            keyed["".join(c for c in s.upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = name
    return keyed


_UNITS = "|".join(sorted(C.UNIT_KINDS, key=len, reverse=True))


def _values(x: str, source: str) -> dict[str, str]:
    """CTEs that end in `parsed`: the rows of source with base and kind of the text x."""
    scale = f"case when prefix = '' then 1.0::double when prefix = 'M' then case when kind in ('capacitance', 'inductance') then 1e-6::double else 1e6::double end else coalesce({_case('prefix', C.SI_PREFIXES)}, {_case('lower(prefix)', C.SI_PREFIXES)})::double end"
    return {
        "texts": rf"select *, regexp_replace(regexp_replace({clean(x)}, '(?i)\b(nom|nominal|typ|typical|max|min)\b', '', 'g'), '\s', '', 'g') as t from {source}",
        "shapes": r"select *, regexp_matches(t, '(?i)^\d+[REKMGTpnuf]\d+$') as rkm, regexp_matches(t, '^\d+/\d+[A-Za-z]{1,6}$') as part, regexp_matches(t, '^\d+([.,]\d+)?[A-Za-z]{0,8}$') as plain from texts",
        "split": rf"""select *, case when rkm then regexp_extract(t, '(?i)^\d+([A-Z])', 1) when part then regexp_extract(t, '[A-Za-z]+$') else regexp_extract(t, '[A-Za-z]*$') end as tail,
            case when rkm then replace(regexp_replace(t, '[A-Za-z]', '.'), ',', '.')::double when part and regexp_extract(t, '/(\d+)', 1)::int <> 0 then regexp_extract(t, '^\d+')::double / regexp_extract(t, '/(\d+)', 1)::double
            when plain then replace(regexp_extract(t, '^\d+(?:[.,]\d+)?'), ',', '.')::double end as number from shapes""",
        "units": rf"select *, case when rkm then '' else regexp_extract(upper(tail), '({_UNITS})$', 1) end as unit, case when rkm or regexp_matches(upper(tail), '({_UNITS})$') then '' else regexp_extract(upper(tail), '({_UNITS})S$', 1) end as many from split",
        "kinds": f"select *, case when rkm then case when upper(tail) in ('R', 'E', 'K', 'M', 'G', 'T') then 'resistance' when tail in ('p', 'n', 'u', 'f') then 'capacitance' end else {_case('unit || many', C.UNIT_KINDS)} end as kind, left(tail, length(tail) - length(unit) - case when many <> '' then length(many) + 1 else 0 end) as prefix from units",
        "scaled": f"select *, number * ({scale}) as base from kinds",
        "parsed": "select * replace (case when base is not null then kind end as kind) from scaled",
    }


_MONEY = r"regexp_replace(regexp_extract(price_text, '-?\d[\d,.\s'']*'), '[\s'']', '', 'g')"
_VOTES = rf"""with n as (select part_id % 40 as sheet, {_MONEY} as x from v_spelled),
    k as (select *, contains(x, ',') as c, contains(x, '.') as p, len(x) - len(replace(x, ',', '')) as nc, len(x) - len(replace(x, '.', '')) as np, len(regexp_extract(x, '[^,]*$')) as ct, len(regexp_extract(x, '[^.]*$')) as pt, regexp_matches(x, ',[^.]*$') as comma_last from n)
    select sheet, count(*) filter (case when c and p then comma_last else nc = 1 and ct <> 3 end) as comma_votes, count(*) filter (case when c and p then not comma_last else nc <> 1 and np = 1 and pt <> 3 end) as point_votes,
    comma_votes > 0 and comma_votes >= point_votes as decimal_comma from k group by sheet"""
_EVENT_KIND = "case event_type when 'click' then 'PCN' when 'view' then 'PDN' when 'signup' then 'SUCCESSOR' when 'error' then 'EOL_ANNOUNCED' when 'purchase' then 'LAST_TIME_BUY' else event_type end"
_ADVANCED = f"""advanced as (select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) filter (event_type not in ('click', 'view')) as steps, count(*) filter (event_type in ('click', 'view')) as notices,
    case least(count(*) filter (event_type not in ('click', 'view')), 4) when 0 then 'ACTIVE' when 1 then 'NRND' when 2 then 'EOL_ANNOUNCED' when 3 then 'LAST_TIME_BUY' else 'OBSOLETE' end as state from events group by all)"""
_TOLD = r"(select part_id, unnest(list_transform(list_filter(string_split_regex(replace(replace(description, '/', ' '), ',', ' '), '\s+'), lambda w: regexp_matches(w, '^\d')), lambda w: w)) as w, generate_subscripts(list_filter(string_split_regex(replace(replace(description, '/', ' '), ',', ' '), '\s+'), lambda w: regexp_matches(w, '^\d')), 1) as pos from v_spelled)"


def _cuts(key: str, source: str) -> str:
    return f"select distinct k, left(k, i - 1) || substr(k, i + 1) as form from (select k, unnest(range(1, length(k) + 1)) as i from (select distinct {key} as k from {source}) where length(k) >= 4) union select distinct {key}, {key} from {source} where length({key}) >= 4"


SQL |= {
    "value_parsing": _with(_values("value_text", "v_spelled"), "select part_id, value_text, base, kind from parsed"),
    "value_agreement": _with(
        {f"d_{k}": v.replace("from texts", "from d_texts").replace("from shapes", "from d_shapes").replace("from split", "from d_split").replace("from units", "from d_units").replace("from kinds", "from d_kinds").replace("from scaled", "from d_scaled") for k, v in _values("w", _TOLD).items()}
        | _values("value_text", "v_spelled"),
        """select part_id, told, case when base is null or told is null then null when kind is distinct from told_kind and kind is not null then false when base = 0 or told = 0 then base = told else abs(base - told) <= 0.02::double * greatest(base, told) end as agrees
        from parsed left join (select part_id, arg_min(base, pos) as told, arg_min(kind, pos) as told_kind from d_parsed where kind in ('resistance', 'capacitance', 'inductance', 'frequency') group by part_id) using (part_id)""",
    ),
    "maker_names": _with(
        {
            "makers(k, name)": "values " + ", ".join(f"({_q(k)}, {_q(n)})" for k, n in _aliases(C.MAKER_ALIASES).items()),
            "sellers(k, name)": "values " + ", ".join(f"({_q(k)}, {_q(n)})" for k, n in _aliases(C.DISTRIBUTOR_ALIASES).items()),
            "words": "select part_id, maker_text, seller_text, list_filter(string_split_regex(upper(maker_text), '[^A-Z0-9]+'), lambda w: w <> '') as mw, list_filter(string_split_regex(upper(seller_text), '[^A-Z0-9]+'), lambda w: w <> '') as sw from v_spelled",
            "telling": f"select *, list_filter(mw, lambda w: w not in {_in(C.COMPANY_NOISE)}) as mt, list_filter(sw, lambda w: w not in {_in(C.COMPANY_NOISE)}) as st from words",
            "keys": "select part_id, seller_text, array_to_string(mw, '') as m1, case when len(mt) > 0 then mt else mw end as shown, array_to_string(shown, '') as m2, array_to_string(sw, '') as s1, array_to_string(case when len(st) > 0 then st else sw end, '') as s2 from telling",
        },
        """select part_id, case when m1 = '' then '' else coalesce(a.name, b.name, array_to_string(list_transform(shown, lambda w: case when regexp_matches(w, '^[A-Z]{1,3}$') then w else w[1] || lower(w[2:]) end), ' ')) end as maker,
        case when s1 = '' then '' else coalesce(c.name, d.name, trim(seller_text)) end as seller from keys left join makers a on a.k = m1 left join makers b on b.k = m2 left join sellers c on c.k = s1 left join sellers d on d.k = s2""",
    ),
    "price_texts": with_views(rf"""select part_id, (case when x = '' then null when contains(x, ',') and contains(x, '.') then case when regexp_matches(x, ',[^.]*$') then replace(replace(x, '.', ''), ',', '.') else replace(x, ',', '') end
        when len(x) - len(replace(x, ',', '')) > 1 or regexp_matches(x, ',\d\d\d$') then replace(x, ',', '') else replace(x, ',', '.') end::decimal(18,6)::decimal(38,6) * 1000000)::bigint as micro, currency, currency_code
        from (select part_id, {_MONEY} as x, {'coalesce(' + ', '.join(f"case when contains(upper(price_text), {_q(k)}) then {_q(C.CURRENCY_SYMBOLS[k])} end" for k in sorted(C.CURRENCY_SYMBOLS, key=len, reverse=True)) + ')'} as currency,
        case when c = '' then 'USD' else coalesce({_case('c', C.CURRENCY_SYMBOLS)}, case when regexp_matches(c, '^[A-Z]{{3}}$') then c end, {', '.join(f"case when contains(c, {_q(k)}) then {_q(x)} end" for k, x in C.CURRENCY_SYMBOLS.items())}, 'USD') end as currency_code
        from (select *, replace(upper(trim(currency_text)), ' ', '') as c from v_spelled))"""),
    "comma_convention": with_views(_VOTES).replace(" with n as", ", n as") if with_views(_VOTES) != _VOTES else _VOTES,
    "part_number_hints": _with(
        {"tidy": r"select *, regexp_replace(regexp_replace(upper(trim(mpn_text)), '^[ .\t-]+|[ .\t-]+$', '', 'g'), '\s+', ' ', 'g') as mpn from v_spelled",
         "guessed": "select *, coalesce(" + ", ".join(f"case when starts_with(mpn, {_q(p)}) then {_q(m)} end" for p, m in C.PREFIX_MAKERS) + ", '') as maker from tidy"},
        f"""select part_id, mpn, maker, case when trim(maker_text) = '' then maker else coalesce({_known('upper(trim(maker_text))', C.MAKER_SHORT_NAMES)}, trim(maker_text)) end as maker_hint,
        coalesce({", ".join(f"case when ends_with(mpn, {_q(k)}) and mpn <> {_q(k)} then {_q(C.SUFFIX_PACKAGES[k])} end" for k in sorted(C.SUFFIX_PACKAGES, key=len, reverse=True))}, upper(regexp_extract(mpn_text, '{C.PACKAGE_WORD}', 1))) as package from guessed""",
    ),
    "mount_types": with_views("select package_text, case package_text when '0603' then 'SMD' when '1608 Metric' then 'SMD' when 'DIP8' then 'THT' when 'SOIC8' then 'SMD' when 'TO-220' then 'THT' when 'QFN32' then 'SMD' when 'axial' then 'THT' else '' end as mount, count(*) as parts from v_spelled group by all"),
    "lifecycle_by_day": f"with {_ADVANCED} select user_id, day, state, steps, notices from advanced",
    "lifecycle_choices": f"with {_ADVANCED} select state, count(*) as n, (case state when 'ACTIVE' then 3 when 'NRND' then 3 when 'EOL_ANNOUNCED' then 5 when 'LAST_TIME_BUY' then 3 else 2 end)::bigint as choices from advanced group by state",
    "new_notices": f"select distinct user_id as part_id, {_EVENT_KIND} as event from events e where ts >= timestamp '2024-01-03' and not exists (select 1 from events o where o.user_id = e.user_id and o.event_type = e.event_type and o.ts < timestamp '2024-01-03')",
    "fuzzy_match": _with(
        {
            "given": f"select bom_id, source_row, left(k, pos - 1) || substr(k, pos + 1) as k from (select bom_id, source_row, {mpn_key('mpn')} as k, (source_row % greatest(length({mpn_key('mpn')}), 1) + 1)::int as pos from v_bom_line)",
            "catalogue": f"select {mpn_key('mpn')} as k, min(part_id) as part_id from v_part group by all",
            "given_cuts": _cuts("k", "given"), "part_cuts": _cuts("k", "catalogue"),
            "pairs": "select distinct g.k as a, p.k as b from given_cuts g join part_cuts p using (form)",
            # Both lack at most one character of what they share, so their blocks hold all others of the shorter, or all but one.
            "scored": "select a, part_id, round(case when a = b then 10000.0 else 20000.0 * (case when length(a) = length(b) then length(a) - 1 else least(length(a), length(b)) end) / (length(a) + length(b)) end)::int as similarity from pairs join catalogue on k = b",
            "best": "select a, arg_min(part_id, (-similarity, part_id)) as part_id, max(similarity) as similarity from scored where similarity >= 8800 group by a",
        },
        "select bom_id, source_row, part_id, similarity from given join best on a = k",
    ),
}

_FIGURES = """select bom_id, count(*) as lines, count(*) filter (not dnp) as live, count(*) filter (kind <> 'none') as matched, count(*) filter (not dnp and kind = 'none') as unmatched, count(*) filter (kind <> 'none' and confidence < 90) as review,
    count(*) filter (not dnp and lifecycle is not null and stocking = 1) as single_source, count(*) filter (not dnp and lifecycle is not null and stock <= 0) as out_of_stock, count(*) filter (not dnp and lifecycle is not null and stock <= 0 and lead_days >= 84) as long_lead,
    max(lead_days) filter (not dnp and lifecycle is not null) as max_lead_days, count(*) filter (not dnp and required > 0) as to_cost, count(*) filter (not dnp and required > 0 and unit_micro is not null) as costed,
    count(*) filter (not dnp and rohs = 'Non-compliant') as blockers, count(*) filter (not dnp and rohs <> 'Unknown') as declared, count(*) filter (not dnp and eccn <> 'EAR99') as export from scored group by bom_id"""


def _exploded(keys: str, found: list[tuple[str, str, str]], source: str) -> str:
    each = ", ".join(f"case when {cond} then {{'code': '{code}', 'severity': {severity}}} end" for code, cond, severity in found)
    return f"select {keys}, i.code as code, i.severity as severity from (select {keys}, unnest([{each}]) as i from {source}) where i is not null"


SQL |= {
    "compliance_issues": _scored(_exploded("bom_id, source_row", [("rohs_non_compliant", "rohs = 'Non-compliant'", "'error'"), ("rohs_exempt", "rohs = 'Exempt'", "'warning'"), ("rohs_unknown", "rohs = 'Unknown'", "'warning'"), ("reach_svhc", "reach = 'Non-compliant'", "'warning'"), ("export_controlled", "eccn <> 'EAR99'", "'warning'")], "scored where not dnp and lifecycle is not null")),
    "match_issues": _with(
        _matched(_ROWS["source_row % 3"], "select * replace (case when part_id % 50 = 0 then mpn || 'Z9' else mpn end as mpn) from v_part"),
        _exploded("bom_id, source_row", [("no_catalogue_match", "kind = 'none' and not dnp", "'error'"), ("match_needs_review", "kind <> 'none' and confidence < 90", "case when confidence >= 60 then 'warning' else 'error' end"), ("match_packaging_variant", "kind = 'root'", "'info'")], "(select * from matched join v_bom_line using (bom_id, source_row))"),
    ),
    "risk_issues": _scored("select bom_id, source_row, 'risk_' || code as code, case when x >= 85 then 'error' else 'warning' end as severity from (" + " union all ".join(f"select bom_id, source_row, '{k}' as code, f_{k} as x from scored where not dnp" for k in C.WEIGHTS) + ") where x >= 60"),
    "analysis_summary": _scored(_FIGURES),
    "analysis_issues": _scored(_exploded("bom_id", [
        ("unmatched_lines", "unmatched > 0", "case when unmatched * 4 > live then 'error' else 'warning' end"), ("matches_need_review", "review > 0", "'warning'"), ("out_of_stock", "out_of_stock > 0", "case when out_of_stock > 2 then 'error' else 'warning' end"),
        ("single_source", "single_source > 0", "'warning'"), ("long_lead", "long_lead > 0", "'warning'"), ("cost_coverage", "costed * 100 < to_cost * 90", "'warning'"), ("compliance_blockers", "blockers > 0", "'error'"), ("compliance_coverage_low", "declared * 100 < live * 80", "'warning'"), ("compliance_export", "export > 0", "'warning'"),
    ], f"({_FIGURES})")),
}


_WORDS = "values " + ", ".join(f"('{k}', '{f}', {w})" for k, (f, w) in C.HEADER_WORDS.items())
_SHEET = {
    "words(k, field, weight)": _WORDS,
    "cells": f"select sheet, row_no, list_transform(string_split(cells_text, '|'), lambda c: {clean('c')}) as cells from v_sheet",
    "filled": "select *, list_filter(cells, lambda c: c <> '') as filled from cells",
    "counted": """select sheet, row_no, count(w.k) as hits, count(*) filter (w.field in ('mpn', 'quantity')) as needed, count(*) as n, count(*) filter (regexp_matches(c, '^-?[\\d.,]+$')) as numeric, count(*) filter (length(c) > 48) as long, count(distinct key) as keys
        from (select sheet, row_no, c, regexp_replace(lower(c), '[^a-z0-9]+', '', 'g') as key from (select sheet, row_no, unnest(filled) as c from filled where row_no <= 40)) left join words w on w.k = key group by all""",
    "scored": """select *, case when n < 2 then 0 else greatest(0.0::double, hits * 12.0::double + needed * 10.0::double + hits / n * 25.0::double + n / 6 * 12.0::double + keys / n * 10.0::double - numeric / n * 40.0::double - long / n * 25.0::double + case when needed >= 2 then 18.0::double else 0.0::double end) end - (row_no - 1) * 0.35::double as score from counted""",
    "best": "select sheet, arg_max(row_no, (score, -row_no)) as row_no, arg_max(hits, (score, -row_no)) as hits from scored where score > 0 and n >= 2 group by sheet",
    "guess": "select sheet, min(row_no) as row_no, arg_min(hits, row_no) as hits from scored where n >= 2 and row_no <= 10 group by sheet",
    "heads": "select g.sheet, case when b.hits > 0 then b.row_no else g.row_no end as header_row, case when b.hits > 0 then b.hits else g.hits end::int as hits from guess g left join best b using (sheet)",
    "mapped": """select sheet, arg_min(col, (-weight, col))::int as "column", field, max(weight) as weight from (
        select sheet, unnest(range(len(cells))) as col, unnest(cells) as c from filled join heads using (sheet) where row_no = header_row) join words on k = regexp_replace(lower(c), '[^a-z0-9]+', '', 'g') group by sheet, field""",
}
_LABEL, _BANNER, _TOTAL = C.TITLE_LABEL, C.SECTION_BANNER, C.TOTAL_ROW
SQL |= {
    "sheet_headers": _with(_SHEET, "select sheet, header_row, hits from heads"),
    "sheet_titles": _with(
        _SHEET
        | {"pairs": f"""select sheet, row_no, case when whole then trim(regexp_replace(filled[1], ':+$', '')) else label end as label, case when whole then rest else coalesce(nullif(after, ''), rest) end as value from (
            select *, regexp_matches(filled[1], '{_LABEL}') as whole, trim(string_split(filled[1], ':')[1]) as label, trim(regexp_replace(filled[1], '^[^:]*:?', '')) as after, coalesce(filled[2], '') as rest from filled join heads using (sheet) where row_no < header_row and len(filled) between 1 and 6)
            where whole or (contains(filled[1], ':') and len(filled) <= 2 and regexp_matches(label, '{_LABEL}'))"""},
        "select sheet, label, arg_min(value, row_no) as value from pairs where label <> '' group by sheet, label",
    ),
    "sheet_row_kinds": _with(
        _SHEET
        | {"flags": f"""select *, len(filled) = 1 and (regexp_matches(filled[1], '{_BANNER}') or regexp_matches(filled[1], '^[\\-=*_\\s#]{{3,}}$')) as banner, coalesce(regexp_matches(filled[1], '{_TOTAL}') and len(filled) <= 5, false) as total,
            coalesce(max(len(filled) >= 3) over (partition by sheet order by row_no desc rows between unbounded preceding and 1 preceding), false) as more from filled join heads using (sheet)""",
           "ends": "select *, min(case when row_no > header_row and total and not coalesce(banner, false) and not more then row_no end) over (partition by sheet) as end_row from flags"},
        "select sheet, case when row_no < header_row then 'above' when row_no = header_row then 'header' when row_no > end_row then 'below' when len(filled) = 0 then 'blank' when banner then 'banner' when total then 'total' else 'data' end as kind, count(*) as rows from ends group by all",
    ),
    "sheet_columns": _with(_SHEET, 'select sheet, "column", field, weight from mapped'),
    "mapping_confidence": _with(_SHEET, f"select sheet, count(*) as mapped, ((sum(weight * h) * 200 + sum(h)) // (sum(h) * 2))::bigint as confidence from (select *, coalesce({_case('field', C.FIELD_HALVES)}, 1) as h from mapped) group by sheet"),
}
SQL["sheet_fingerprints"] = _with(
    _SHEET | {"keys": "select sheet, list_sort(list_distinct(list_filter(list_transform(cells, lambda c: regexp_replace(lower(c), '[^a-z0-9]+', '', 'g')), lambda c: c <> ''))) as keys from filled join heads using (sheet) where row_no = header_row"},
    "select sheet, substr(sha1(array_to_string(keys, '|')), 1, 16) as fingerprint, len(keys)::int as headers from keys",
)

"""SQL for alternates by source, for an engine that knows the driver's tables only."""

from __future__ import annotations

from partloom import constants as C
from partloom.plans.oracle import _SUPPLY, _case, _q, _usd, _values, _with, clean, mpn_key, package, tokens

_RISKY = "('NRND', 'EOL', 'Obsolete')"
_WORDS = r"list_filter(string_split_regex(replace(replace(description, '/', ' '), ',', ' '), '\s+'), lambda w: regexp_matches(w, '^\d'))"
_SPLIT = rf"list_filter(list_transform(string_split_regex({clean('{0}')}, '[,;|]+| / '), lambda p: trim(p)), lambda p: p <> '')"
_PERCENT = rf"coalesce(try_cast(regexp_extract({clean('{0}')}, '(\d+(?:\.\d+)?)\s*%', 1) as double), {_case(f'upper({clean("{0}")})', C.TOLERANCE_LETTERS)}::double)"
_MOUNT = "case when {0} is null then null when {0} = '' then '' when {0} = 'THT' then 'THT' else 'SMD' end"  # of the fixture's footprints
_VAGUE = "('', 'THT')"
_LOWEST = f"select part_id, min({_usd('unit_micro')}) as usd_micro from (select part_id, supp_id, min(unit_micro) as unit_micro from v_price_break where unit_micro > 0 group by all) join v_offer o using (part_id, supp_id) group by part_id"


_FEET = f"select x, {package('x')} as foot from (select package as x from v_pool_line union select package from v_pool_part)"


def _searches(lines: str, catalogue: str) -> dict[str, str]:
    """CTEs that end in `searches`: bom_id, source_row and what each of the lines would search for."""
    pieces = ", ".join(clean(x) for x in ("p.category", "p.value", "p.tolerance", "p.package", "l.value")) + f", foot, {clean('l.tolerance')}"
    return {
        "feet": _FEET,
        "pieces": f"select l.bom_id, l.source_row, l.description, list_filter([{pieces}], lambda p: p <> '') as told from {lines} l join feet on feet.x = l.package left join {catalogue} p using (part_id)",
        "chosen": f"select bom_id, source_row, case when len(told) > 0 then told else {tokens('description')}[:6] end as c from pieces",
        "lowered": "select *, list_transform(c, lambda q: lower(q)) as low from chosen",
        "searches": "select bom_id, source_row, array_to_string(list_filter(c, lambda p, i: list_position(low, low[i]) = i)[:8], ' ') as search from lowered",
    }


_NEAR = "greatest({0}, {1}) / least({0}, {1}) < 1.03::double"
_DIFFER = "coalesce({0} <> {1}, false)"
_VALUE = f"""case when asked is not null then coalesce(
    case when c_base is null then null when {_DIFFER.format('asked_kind', 'c_kind')} then false when asked = 0 or c_base = 0 then asked = c_base else abs(asked - c_base) <= 0.02::double * greatest(abs(asked), abs(c_base)) end,
    case when c_told is null or c_told = 0 then null when {_DIFFER.format('asked_kind', 'c_told_kind')} then false when asked = 0 then false else {_NEAR.format('asked', 'c_told')} end)
    when said is null or c_told is null then null when {_DIFFER.format('said_kind', 'c_told_kind')} then false when said = 0 or c_told = 0 then said = c_told else {_NEAR.format('said', 'c_told')} end"""
_PIN = f"case when wanted_package in {_VAGUE} or c_package_key in {_VAGUE} then null else wanted_package = c_package_key end"
_DOUBTS = {
    "lifecycle": "c_lifecycle not in ('Active', 'New')", "no stock": "c_stock <= 0", "one source": "c_stock > 0 and c_stocking = 1", "footprint differs": "not pin", "footprint unknown": "pin is null", "mounting differs": "mounts", "value differs": "not same",
    "value unknown": "same is null", "looser tolerance": "c_percent > wanted_percent + 0.001::double", "other category": "o_category <> c_category and o_category <> '' and c_category <> ''", "not RoHS": "c_rohs = 'Non-compliant'",
    "export controlled": "c_eccn <> 'EAR99'", "dearer": "c_usd is not null and o_usd > 0 and (c_usd - o_usd) * 100 > o_usd * 5",
}

_POOL = {
    "every_text": f"select value as x from v_pool_part union select value from v_pool_line union select unnest({_WORDS}) from v_pool_part union select unnest({_WORDS}) from v_pool_line",
    **_values("x", "every_text"),
    "meaning": "select x, base, kind from parsed where base is not null",
    "descriptions": "select distinct description from v_pool_part union select distinct description from v_pool_line",
    "telling": f"select description, arg_min(base, pos) as told, arg_min(coalesce(kind, ''), pos) as told_kind from (select description, unnest({_WORDS}) as x, generate_subscripts({_WORDS}, 1) as pos from descriptions) join meaning using (x) where kind in ('resistance', 'capacitance', 'inductance', 'frequency') group by description",
    "lowest": _LOWEST,
    "feet": _FEET,
    "catalogue": f"""select p.*, {mpn_key('p.mpn')} as key, feet.foot as package_key, m.base, m.kind, t.told, t.told_kind, {_PERCENT.format('p.tolerance')} as percent, coalesce(s.stock, 0) as stock, coalesce(s.stocking, 0) as stocking, coalesce(usd_micro, median_1k_micro) as usd
        from v_pool_part p join feet on feet.x = p.package left join meaning m on m.x = p.value left join telling t on t.description = p.description left join ({_SUPPLY}) s using (part_id) left join lowest using (part_id)""",
    "wanted": f"""select l.*, {_SPLIT.format('l.alternates')} as declared, coalesce(c.key, {mpn_key('l.mpn')}) as own_key, c.lifecycle as life, c.stock as own_stock from v_pool_line l left join catalogue c using (part_id)
        where not dnp and (len({_SPLIT.format('l.alternates')}) > 0 or coalesce(c.lifecycle in ('NRND', 'EOL', 'Obsolete', 'Unknown') or c.stock <= 0 or c.stock < required or c.stocking < 2 or c.rohs = 'Non-compliant', false))""",
    "by_key": "select key, min(part_id) as candidate_id from catalogue where key <> '' group by key",
    "declared_ones": f"select bom_id, source_row, candidate_id, 'bom' as source from (select bom_id, source_row, {mpn_key('a')} as key from (select bom_id, source_row, unnest(declared) as a from wanted)) join by_key using (key)",
    "published_ones": f"select part_id, candidate_id, 'substitution' as source from (select part_id, {mpn_key('a')} as key from (select part_id, unnest(({_SPLIT.format('published')})[:6]) as a from catalogue)) join by_key using (key)",
    "similar_ones": "select part_id, candidate_id, 'similar' as source from (select a.part_id, b.part_id as candidate_id, row_number() over (partition by a.part_id order by b.stock desc, b.part_id) as place from catalogue a join catalogue b on a.category = b.category and a.package_key = b.package_key and a.base = b.base and a.kind is not distinct from b.kind and a.part_id <> b.part_id where a.category <> '') where place <= 10",
    "found_ones": "select * from declared_ones union all select bom_id, source_row, candidate_id, source from wanted join (select * from published_ones union all select * from similar_ones) using (part_id)",
    "nothing": f"select * from wanted l where (life in {_RISKY} or own_stock <= 0) and not exists (select 1 from found_ones f where f.bom_id = l.bom_id and f.source_row = l.source_row)",
    **{k: v for k, v in _searches("nothing", "catalogue").items() if k != "feet"},
    "lost": f"select bom_id, source_row, list_sort(list_distinct({tokens('search')})) as words from searches",
    "postings": f"select part_id, unnest(list_distinct({tokens('concat_ws(chr(32), description, category, value, package, manufacturer)')})) as word from catalogue",
    "asked_words": "select ask, unnest(ask) as word from (select distinct words as ask from lost)",
    "hits": "select ask, part_id as candidate_id, row_number() over (partition by ask order by count(*) desc, part_id) as place from asked_words join postings using (word) group by ask, part_id",
    "candidates": "select * from found_ones union all select bom_id, source_row, candidate_id, 'search' as source from lost join hits on words = ask where place <= 10",
    "met": f"""select l.bom_id, l.source_row, l.own_key, l.required, f.source, f.candidate_id, c.key, c.mpn, c.manufacturer, c.lifecycle as c_lifecycle, c.stock as c_stock, c.stocking as c_stocking, c.rohs as c_rohs, c.eccn as c_eccn, c.category as c_category, c.usd as c_usd, c.package_key as c_package_key,
        c.base as c_base, c.kind as c_kind, c.told as c_told, c.told_kind as c_told_kind, c.percent as c_percent, {_MOUNT.format('c.package_key')} as c_mount, o.lifecycle as o_lifecycle, o.category as o_category, o.usd as o_usd, o.manufacturer as o_maker,
        case when l.value <> '' then m.base else o.base end as asked, case when l.value <> '' then m.kind else o.kind end as asked_kind, case when coalesce(o.description, '') <> '' then o.told else t.told end as said, case when coalesce(o.description, '') <> '' then o.told_kind else t.told_kind end as said_kind,
        coalesce({_PERCENT.format('l.tolerance')}, o.percent) as wanted_percent, case when l.package <> '' then feet.foot else coalesce(o.package_key, '') end as wanted_package,
        case when l.package <> '' then {_MOUNT.format('feet.foot')} else coalesce({_MOUNT.format('o.package_key')}, '') end as wanted_mount
        from wanted l join feet on feet.x = l.package join candidates f using (bom_id, source_row) join catalogue c on c.part_id = f.candidate_id left join catalogue o on o.part_id = l.part_id left join meaning m on m.x = l.value left join telling t on t.description = l.description""",
    "judged": f"select *, {_PIN} as pin, {_VALUE} as same, wanted_mount <> '' and c_mount <> '' and wanted_mount <> c_mount as mounts from met",
    "rated": f"""select *, 40 + {_case('source', C.SOURCE_BONUS)}
        + case c_lifecycle when 'Active' then 16 + case when o_lifecycle in {_RISKY} then 6 else 0 end when 'New' then 12 when 'Unknown' then -4 else -30 end
        + case when c_stock <= 0 then -24 else case when required > 0 and c_stock >= 2 * required then 14 when required > 0 and c_stock >= required then 8 else 4 end + case when c_stocking >= 2 then 6 else 0 end end
        + case when pin then 18 when not pin then -34 else 0 end + case when mounts then -20 else 0 end + case when same then 14 when not same then -40 else 0 end
        + case when c_percent <= wanted_percent + 0.001::double then 5 when c_percent > wanted_percent + 0.001::double then -12 else 0 end
        + case when o_category <> '' and c_category <> '' then case when o_category = c_category then 5 else -10 end else 0 end + case when o_maker = manufacturer then 4 else 0 end
        + case c_rohs when 'Non-compliant' then -30 when 'Compliant' then 3 else 0 end + case when c_eccn <> 'EAR99' then -8 else 0 end
        + case when c_usd is null or o_usd is null or o_usd <= 0 then 0 when d <= -20 * o_usd then 10 when d <= 5 * o_usd then 5 when d <= 40 * o_usd then -5 when d <= 100 * o_usd then -14 when d <= 300 * o_usd then -22 else -32 end as total,
        least(case when not same then 30 else 100 end, case when not pin then 52 else 100 end, case when same is null and source in ('similar', 'search') then 62 else 100 end, case when pin is null and source = 'search' then 58 else 100 end) as ceiling,
        array_to_string(list_filter([{", ".join(f"case when {when} then {_q(name)} end" for name, when in _DOUBTS.items())}], lambda x: x is not null), ', ') as concerns from (select *, (c_usd - o_usd) * 100 as d from judged)""",
    "scored": "select *, greatest(least(total, ceiling), 0)::int as score from rated where key <> '' and key is distinct from own_key",
    "once": f"select * from scored qualify row_number() over (partition by bom_id, source_row, key order by score desc, {_case('source', {s: i for i, s in enumerate(C.SOURCE_BONUS)})}, candidate_id) = 1",
    "placed": "select *, row_number() over (partition by bom_id, source_row order by score desc, mpn, candidate_id)::int as place, case when pin then 'drop-in' when not pin then 'needs review' else 'likely fit' end as verdict from once",
}

SQL: dict[str, str] = {
    "alternates_by_source": _with(_POOL, "select bom_id, source_row, place, candidate_id, mpn, source, score, verdict, concerns, mpn || ' (' || manufacturer || '), ' || score || '/100, ' || verdict as described from placed where place <= 5"),
    "part_searches": _with(_searches("v_pool_line", "v_pool_part"), "select * from searches"),
}

"""Registered queries over the driver's tables: each a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom import constants as C
from partloom.functions import money as M
from partloom.functions import names as N
from partloom.functions import text as T
from partloom.functions import units as U
from partloom.functions import values as X
from partloom.functions import vocab as V
from partloom.operators import alternates, candidates, catalogue, completions, cost, evidence, history, issues, lines, mapping, match, normalise, records, replacements, risk, sheets, tables
from partloom.plans import analysis
from partloom.sinks import files
from partloom.sources.cuts import written
from partloom.sources.views import PRICE_STEPS, Frames
from partloom.streaming import staleness

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
    """Registers a function of the frames under its name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
    return f


@query
def text_keys(v: Frames) -> DataFrame:
    x = F.regexp_replace("text", r"[^\x00-\x7F]", "_")  # engines differ in the upper case of some letters
    return v["benchmark"].select("item_id", T.slug(x).alias("slug"), T.header_key(x).alias("header_key"), F.size(T.tokens(x)).alias("n_tokens"), F.array_join(T.tokens(x), " ").alias("tokens"), T.shorten(x, 40).alias("short"), T.csv_safe(x).alias("safe"))


@query
def mpn_keys(v: Frames) -> DataFrame:
    x = F.col("mpn")
    return v["v_part"].select("part_id", T.normalize_mpn(x).alias("mpn_key"), T.mpn_root(x).alias("root"))


@query
def package_names(v: Frames) -> DataFrame:
    x = F.col("package")
    return v["v_part"].select("part_id", U.normalize_package(x).alias("package_key"), U.packages_equivalent(x, F.lit("1608 Metric")).alias("is_0603"))


@query
def cell_parsing(v: Frames) -> DataFrame:
    q = F.concat(F.lit("1,"), F.lpad((F.col("part_id") % 1000).cast("string"), 3, "0"), F.when(F.col("part_id") % 2 == 0, " pcs").otherwise(" ea"))
    t = F.when(F.col("part_id") % 3 == 0, F.concat((F.col("part_id") % 10).cast("string"), F.lit("%"))).otherwise(F.when(F.col("part_id") % 3 == 1, "F").otherwise("k"))
    lead = F.when(F.col("part_id") % 4 == 0, F.concat((F.col("part_id") % 30).cast("string"), F.lit(" weeks"))).when(F.col("part_id") % 4 == 1, "In stock").when(F.col("part_id") % 4 == 2, "Out of stock").otherwise(F.concat((F.col("part_id") % 90).cast("string"), F.lit("-"), (F.col("part_id") % 90 + 10).cast("string"), F.lit(" days")))
    d = U.parse_lead_time_days(lead)
    return v["v_part"].select("part_id", U.parse_quantity(q).alias("quantity"), U.parse_tolerance(t).alias("tolerance"), d.alias("lead_days"), U.format_lead_time(d).alias("lead_text"))


@query
def states_of_wording(v: Frames) -> DataFrame:
    life = F.concat(F.lit("Status: "), F.when(F.col("part_id") % 5 == 0, "Not Recommended for New Designs").when(F.col("part_id") % 5 == 1, "Last Time Buy").when(F.col("part_id") % 5 == 2, "Discontinued").when(F.col("part_id") % 5 == 3, "In production").otherwise("?"))
    rohs = F.when(F.col("part_id") % 4 == 0, "ROHS3 Compliant").when(F.col("part_id") % 4 == 1, "RoHS non-compliant").when(F.col("part_id") % 4 == 2, "Compliant by exemption").otherwise("No SVHC")
    return v["v_part"].select("part_id", V.lifecycle(life).alias("lifecycle"), V.compliance_state(rohs).alias("rohs"))


@query
def refdes_expand(v: Frames) -> DataFrame:
    return v["v_bom_line"].select("bom_id", "source_row", F.posexplode(T.split_refdes(F.col("ref_text"))).alias("pos", "ref"))


@query
def refdes_collapse(v: Frames) -> DataFrame:
    refs = v["v_bom_line"].select("bom_id", F.explode(T.split_refdes(F.col("ref_text"))).alias("ref"))
    return lines.collapse_refdes(refs, ["bom_id"])


@query
def refdes_conflicts(v: Frames) -> DataFrame:
    return lines.refdes_conflicts(lines.keyed(v["v_bom_line"]))


@query
def near_duplicate_mpn(v: Frames) -> DataFrame:
    """Every other line names its part without the packaging."""
    return lines.near_duplicates(lines.keyed(v["v_bom_line"].withColumn("mpn", F.when(F.col("source_row") % 2 == 0, T.mpn_root(F.col("mpn"))).otherwise(F.col("mpn")))))


@query
def merge_duplicates(v: Frames) -> DataFrame:
    return lines.merge_duplicates(lines.keyed(v["v_bom_line"])).select("bom_id", "line_no", "source_row", "quantity", "merged", "dnp", "mpn", "manufacturer", "package", F.array_join(F.array_sort("refs"), ",").alias("designators"))


@query
def line_rules(v: Frames) -> DataFrame:
    return lines.line_issues(lines.keyed(v["v_bom_line"]))


@query
def bom_rules(v: Frames) -> DataFrame:
    return lines.bom_issues(v["v_bom_line"])


@query
def issue_counts(v: Frames) -> DataFrame:
    return lines.line_issues(lines.keyed(v["v_bom_line"])).groupBy("bom_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def line_summary(v: Frames) -> DataFrame:
    return lines.summary(lines.keyed(v["v_bom_line"]))


@query
def dnp_lines(v: Frames) -> DataFrame:
    note = F.when(F.col("dnp"), "do not fit").when(F.col("source_row") % 7 == 0, "DNP (option)").when(F.col("source_row") % 5 == 0, "open").otherwise("fitted")
    return v["v_bom_line"].where(T.looks_dnp(note)).select("bom_id", "source_row")


@query
def provider_merge(v: Frames) -> DataFrame:
    return catalogue.merge_providers(v["v_provider_part"])


@query
def offer_dedupe(v: Frames) -> DataFrame:
    return catalogue.best_offers(v["v_offer"]).select("part_id", "distributor", "supp_id", "stock", "moq")


@query
def part_supply(v: Frames) -> DataFrame:
    return catalogue.supply(v["v_offer"])


@query
def price_at_quantity(v: Frames) -> DataFrame:
    got = catalogue.ladders(v["v_price_break"]).withColumn("step", M.price_at_quantity(F.col("ladder"), (F.col("part_id") * 37 + F.col("supp_id")) % 3000))
    return got.select("part_id", "supp_id", F.col("step.break_qty").alias("break_qty"), F.col("step.unit_micro").alias("unit_micro"))


@query
def order_quantities(v: Frames) -> DataFrame:
    need = F.col("part_id") % 500 + 1
    return v["v_offer"].select("part_id", "supp_id", M.order_quantity(need, F.col("moq"), F.col("spq")).alias("order_qty"), M.required_quantity(F.col("moq") / 8, 100).alias("required"))


@query
def fx_convert(v: Frames) -> DataFrame:
    got = v["v_price_break"].join(v["v_offer"].select("part_id", "supp_id", "currency"), ["part_id", "supp_id"])
    return got.select("part_id", "supp_id", "break_qty", M.to_usd(F.col("unit_micro"), F.col("currency")).alias("usd_micro"))


def _loosely(v: Frames) -> tuple[DataFrame, DataFrame]:
    """A catalogue with some numbers that no line has, and lines of which some lack the packaging."""
    parts = analysis.catalogue_of(v["v_part"].withColumn("mpn", F.when(F.col("part_id") % 50 == 0, F.concat(F.col("mpn"), F.lit("Z9"))).otherwise(F.col("mpn"))))
    return parts, lines.keyed(v["v_bom_line"].drop("part_id").withColumn("mpn", F.when(F.col("source_row") % 3 == 0, T.mpn_root(F.col("mpn"))).otherwise(F.col("mpn"))))


@query
def line_match(v: Frames) -> DataFrame:
    parts, given = _loosely(v)
    return match.classify(given, parts, v["v_offer"])


@query
def match_summary(v: Frames) -> DataFrame:
    return match.summary(match.classify(lines.keyed(v["v_bom_line"].drop("part_id")), analysis.catalogue_of(v["v_part"]), v["v_offer"]))


def _costs(v: Frames) -> DataFrame:
    return cost.line_costs(v["v_thin_line"], v["v_priced_offer"], PRICE_STEPS, medians=v["v_part"])


@query
def line_cost(v: Frames) -> DataFrame:
    return _costs(v).select("bom_id", "source_row", "required", "supp_id", "order_qty", "unit_micro", "extended_micro", "covers", "overbuy", "options", "savings_micro")


@query
def bom_cost_rollup(v: Frames) -> DataFrame:
    return cost.roll_up(_costs(v))


@query
def price_comparison(v: Frames) -> DataFrame:
    return cost.against_input(_costs(v))


@query
def price_curve(v: Frames) -> DataFrame:
    return cost.price_curve(v["v_part"], v["v_offer"], catalogue.ladders(v["v_price_break"]))


@query
def split_basket(v: Frames) -> DataFrame:
    wanted = cost.demands(v["v_bom_line"])
    return cost.split_baskets(cost.options(wanted, cost.usable_offers(v["v_offer"]), catalogue.ladders(v["v_price_break"])))


@query
def line_risk(v: Frames) -> DataFrame:
    return analysis.scored_lines(v).select("bom_id", "source_row", "part_id", "kind", *[F.col(f"f_{k}").alias(k) for k in risk.FACTORS], "score", "level")


@query
def risk_factors(v: Frames) -> DataFrame:
    return risk.long_factors(analysis.scored_lines(v, numbered=False), ["bom_id"]).groupBy("bom_id", "code").agg(F.count_if(F.col("factor_score") >= 60).alias("warnings"), F.count_if(F.col("factor_score") >= 85).alias("errors"))


@query
def risk_flags(v: Frames) -> DataFrame:
    return analysis.scored_lines(v).select("bom_id", "source_row", F.array_join(risk.flags(), "|").alias("flags"))


@query
def top_risks(v: Frames) -> DataFrame:
    return risk.top_risks(analysis.scored_lines(v))


@query
def bom_health(v: Frames) -> DataFrame:
    return risk.health(analysis.scored_lines(v, numbered=False))


@query
def distribution_counters(v: Frames) -> DataFrame:
    return risk.counters(analysis.scored_lines(v, numbered=False))


@query
def compliance_summary(v: Frames) -> DataFrame:
    return analysis.compliance_summary(analysis.supplied_lines(v, numbered=False))


@query
def needs_alternates(v: Frames) -> DataFrame:
    return alternates.needs(analysis.supplied_lines(v)).select("bom_id", "source_row", "part_id")


@query
def alternates_topk(v: Frames) -> DataFrame:
    return alternates.best(alternates.scores(alternates.prepared(v["v_part"], catalogue.supply(v["v_offer"])))).select("part_id", "place", "candidate_id", "score")


def _pool(v: Frames) -> DataFrame:
    return candidates.prepared(v["v_pool_part"], catalogue.supply(v["v_offer"]), candidates.unit_prices(v["v_offer"], v["v_price_break"]))


@query
def alternates_by_source(v: Frames) -> DataFrame:
    return candidates.alternates(v["v_pool_line"], _pool(v))


@query
def part_searches(v: Frames) -> DataFrame:
    """What each line would search the catalogue for."""
    own = ("category", "value", "tolerance", "package")
    known = v["v_pool_part"].select("part_id", *[F.col(c).alias(f"o_{c}") for c in own])
    text = candidates.search_text({c: F.col(c) for c in ("value", "package", "tolerance", "description")}, {c: F.col(f"o_{c}") for c in own})
    return v["v_pool_line"].join(known, "part_id", "left").select("bom_id", "source_row", text.alias("search"))


@query
def keyword_search(v: Frames) -> DataFrame:
    """What a buyer types, a whole text with a part's maker and description where there is one of that id, against all parts."""
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "_")  # engines differ in the upper case of some letters
    typed = v["benchmark"].join(v["v_part"], F.col("item_id") == F.col("part_id"), "left").select("item_id", F.concat_ws(" ", "manufacturer", text, "description").alias("text"))
    return alternates.keyword_search(typed, v["v_part"].withColumn("description", F.concat_ws(" ", "description", "manufacturer")))


@query
def snapshot_trend(v: Frames) -> DataFrame:
    return history.trends(v["v_snapshot"])


@query
def snapshot_series(v: Frames) -> DataFrame:
    return history.series(v["v_snapshot"])


@query
def part_dossier(v: Frames) -> DataFrame:
    return history.dossier(v["v_snapshot"])


@query
def stale_parts(v: Frames) -> DataFrame:
    return history.stale(v["v_snapshot"], "2001-12-01", 30)


@query
def recent_parts(v: Frames) -> DataFrame:
    return history.recent(v["v_snapshot"], 50)


@query
def rate_limit_window(v: Frames) -> DataFrame:
    return history.arrivals_in_window(v["events"])


@query
def lifecycle_fold(v: Frames) -> DataFrame:
    return history.lifecycle_fold(v["events"])


@query
def event_sessions(v: Frames) -> DataFrame:
    return history.sessions(v["events"])


@query
def events_per_minute(v: Frames) -> DataFrame:
    got = v["events"].groupBy(F.window(F.col("ts").cast("timestamp"), "1 minute").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "event_type", "n", "value_cents")


@query
def column_profile(v: Frames) -> DataFrame:
    """Share of cells of each column that look like a kind of field, in thousandths."""
    p = v["v_part"]
    cells = p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in ("mpn", "manufacturer", "description", "package", "value_text", "lifecycle")])))
    per_mille = lambda cond: F.floor((F.count_if(cond) * 2000 + F.count(F.lit(1))) / (F.count(F.lit(1)) * 2)).cast("long")
    return cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct(F.upper("cell")).alias("distinct_cells"), per_mille(F.col("cell") == "").alias("blank"), per_mille(F.col("cell").rlike(r"^\d+(\.\d+)?$")).alias("numeric"),
        per_mille(F.col("cell").rlike(r"^[A-Za-z0-9][A-Za-z0-9\-/.#+ ()]{3,}$") & F.col("cell").rlike("[0-9]") & F.col("cell").rlike("[A-Za-z]")).alias("mpn_like"), per_mille(F.col("cell").rlike(r"(?i)^\d+(\.\d+)?\s*(k|m|u|n|p)?(ohm|r|f|nf|uf|pf|h|uh)$")).alias("value_like"),
    )


@query
def header_fingerprint(v: Frames) -> DataFrame:
    """A key for the set of columns that each source's documents fill, for finding a known layout again."""
    keys = v["events"].groupBy("user_id").agg(F.collect_set(T.header_key(F.col("event_type"))).alias("k"))
    return keys.select("user_id", F.substring(F.sha1(F.array_join(F.array_sort("k"), "|").cast("binary")), 1, 16).alias("fingerprint"), F.size("k").alias("headers"))


@query
def page_text_cells(v: Frames) -> DataFrame:
    """Cells of web pages: tags stripped to blanks, as for tables in HTML files."""
    cells = F.regexp_extract_all(F.col("html"), F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))
    return v["pages"].select("page_id", F.posexplode(cells).alias("pos", "cell")).select("page_id", "pos", F.trim(F.regexp_replace("cell", "<[^>]*>", " ")).alias("cell"))


def _claims(v: Frames) -> DataFrame:
    kind = F.element_at(F.array(F.lit("manufacturer"), F.lit("distributor"), F.lit("mock")), F.col("provider") + 1)
    sure = F.when(F.col("provider") == 0, 900).when(F.col("part_id") % 6 == 0, 450).otherwise(700)
    return v["v_provider_part"].withColumns({"source": F.col("provider").cast("string"), "source_type": kind, "confidence": sure})


@query
def fact_merge(v: Frames) -> DataFrame:
    return evidence.merged_facts(_claims(v))


@query
def fact_evidence(v: Frames) -> DataFrame:
    return evidence.evidence(_claims(v))


@query
def source_offers(v: Frames) -> DataFrame:
    """A region stands for a distributor that several sources list."""
    price = v["v_price_break"].where("break_qty = 1").select("part_id", "supp_id", "unit_micro")
    offers = v["v_offer"].withColumn("available", F.col("stock") > 0)
    got = evidence.first_available(offers, ["part_id", "region"], "supp_id").join(price, ["part_id", "supp_id"])
    return got.select("part_id", "region", "supp_id", "available", evidence.dossier_usd(F.col("unit_micro"), F.col("currency")).alias("usd_micro"))


@query
def part_risk(v: Frames) -> DataFrame:
    return evidence.part_risk(v["v_part"], v["v_snapshot"], v["v_offer"], "2000-06-01")


@query
def replacements_topk(v: Frames) -> DataFrame:
    volts = F.when(F.col("part_id") % 3 == 1, "3-5").when(F.col("part_id") % 3 == 2, "4 V").otherwise("")
    stock = v["v_offer"].groupBy("part_id").agg((F.sum("stock") > 0).alias("available"))
    return replacements.best(v["v_part"].withColumn("voltage", volts).join(stock, "part_id", "left").fillna(False, ["available"]))


@query
def quote_rows(v: Frames) -> DataFrame:
    return files.quote_rows(analysis.supplied_lines(v, carry=("mpn", "manufacturer")))


@query
def compliance_exceptions(v: Frames) -> DataFrame:
    return files.compliance_exceptions(analysis.supplied_lines(v))


@query
def value_parsing(v: Frames) -> DataFrame:
    got = v["v_spelled"].select("part_id", "value_text", X.parse_value(F.col("value_text")).alias("value"))
    return got.select("part_id", "value_text", F.col("value.base").alias("base"), F.col("value.kind").alias("kind"))


@query
def value_agreement(v: Frames) -> DataFrame:
    """Whether the value column and the description's value agree, the latter in its shown form."""
    got = v["v_spelled"].select("part_id", X.parse_value(F.col("value_text")).alias("value"), X.value_from_text(F.col("description")).alias("told"))
    return got.select("part_id", F.col("told.base").alias("told"), X.same_value(F.col("value"), F.col("told"), 0.02).alias("agrees"))


@query
def maker_names(v: Frames) -> DataFrame:
    return v["v_spelled"].select("part_id", N.normalize_manufacturer(F.col("maker_text")).alias("maker"), N.normalize_distributor(F.col("seller_text")).alias("seller"))


@query
def price_texts(v: Frames) -> DataFrame:
    got = v["v_spelled"].select("part_id", X.parse_money(F.col("price_text")).alias("m"), X.normalize_currency(F.col("currency_text")).alias("currency_code"))
    return got.select("part_id", (F.col("m.amount") * 1_000_000).cast("long").alias("micro"), F.col("m.currency").alias("currency"), "currency_code")


@query
def comma_convention(v: Frames) -> DataFrame:
    """For each group of price cells, as for each column of a sheet, whether they use decimal commas."""
    comma, point = X.comma_votes(F.col("price_text"))
    got = v["v_spelled"].groupBy((F.col("part_id") % 40).alias("sheet")).agg(comma.alias("comma_votes"), point.alias("point_votes"))
    return got.withColumn("decimal_comma", (F.col("comma_votes") > 0) & (F.col("comma_votes") >= F.col("point_votes")))


@query
def part_number_hints(v: Frames) -> DataFrame:
    tidy = N.tidy_mpn(F.col("mpn_text"))
    return v["v_spelled"].select("part_id", tidy.alias("mpn"), N.guess_manufacturer(tidy).alias("maker"), N.maker_hint(F.col("maker_text"), tidy).alias("maker_hint"), N.guess_package(tidy, F.col("mpn_text")).alias("package"))


@query
def mount_types(v: Frames) -> DataFrame:
    return v["v_spelled"].groupBy(X.mount_type(F.col("package_text")).alias("mount"), "package_text").agg(F.count(F.lit(1)).alias("parts"))


@query
def lifecycle_by_day(v: Frames) -> DataFrame:
    """The state after a day's events of a user taken as a part, from active on, and the notices among them."""
    kinds = v["events"].select("user_id", F.to_date("ts").cast("string").alias("day"), history.event_kind(F.col("event_type")).alias("kind"))
    return history.advanced(kinds, ["user_id", "day"])


@query
def lifecycle_choices(v: Frames) -> DataFrame:
    """How many states may follow the one that each user's events lead to."""
    kinds = v["events"].select("user_id", F.to_date("ts").cast("string").alias("day"), history.event_kind(F.col("event_type")).alias("kind"))
    return history.advanced(kinds, ["user_id", "day"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.first(F.size(history.may_follow(F.col("state")))).cast("long").alias("choices"))


@query
def new_notices(v: Frames) -> DataFrame:
    """Notices of the last days that are not on file from earlier days: (part, event) pairs, each once."""
    told = v["events"].select(F.col("user_id").alias("part_id"), history.event_kind(F.col("event_type")).alias("event"), (F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")).alias("late"))
    return history.new_notices(told.where("not late").select("part_id", "event"), told.where("late").select("part_id", "event"))


@query
def fuzzy_match(v: Frames) -> DataFrame:
    """Lines whose part number lost a character, matched to the catalogue's most similar number."""
    key = T.normalize_mpn(F.col("mpn"))
    at = (F.col("source_row") % F.greatest(F.length(key), F.lit(1)) + 1).cast("int")
    typed = v["v_bom_line"].select("bom_id", "source_row", F.concat(F.substring(key, F.lit(1), at - 1), F.substring(key, at + 1, F.lit(100))).alias("mpn_key"))
    return match.fuzzy(typed, analysis.catalogue_of(v["v_part"]))


def _odd(v: Frames) -> DataFrame:
    return lines.keyed(v["v_odd_line"].withColumn("alt_mpns", F.array("alt_text")))


@query
def odd_line_rules(v: Frames) -> DataFrame:
    """The rules on lines that break each of them somewhere."""
    return lines.line_issues(_odd(v))


@query
def odd_bom_rules(v: Frames) -> DataFrame:
    return lines.bom_issues(v["v_odd_line"])


@query
def compliance_issues(v: Frames) -> DataFrame:
    return issues.compliance_issues(analysis.supplied_lines(v))


@query
def match_issues(v: Frames) -> DataFrame:
    """Of lines and a catalogue that differ in packaging marks and in some numbers."""
    parts, given = _loosely(v)
    matched = match.classify(given, parts, v["v_offer"], ("dnp", "mpn_key"))
    return issues.match_issues(matched.withColumn("has_part", F.col("mpn_key") != ""))


@query
def risk_issues(v: Frames) -> DataFrame:
    return issues.risk_issues(analysis.scored_lines(v))


@query
def analysis_summary(v: Frames) -> DataFrame:
    return issues.summary(analysis.scored_lines(v, numbered=False))


@query
def analysis_issues(v: Frames) -> DataFrame:
    return issues.bom_issues(issues.summary(analysis.scored_lines(v, numbered=False)))


def _sheets(v: Frames) -> DataFrame:
    return v["v_sheet"].select("sheet", "row_no", F.split("cells_text", r"\|").alias("cells"))


@query
def sheet_headers(v: Frames) -> DataFrame:
    return sheets.headers(_sheets(v)).select("sheet", "header_row", "hits")


@query
def sheet_titles(v: Frames) -> DataFrame:
    return sheets.title_block(_sheets(v), sheets.headers(_sheets(v)))


@query
def sheet_row_kinds(v: Frames) -> DataFrame:
    return sheets.row_kinds(_sheets(v), sheets.headers(_sheets(v))).groupBy("sheet", "kind").agg(F.count(F.lit(1)).alias("rows"))


@query
def sheet_columns(v: Frames) -> DataFrame:
    return sheets.columns(sheets.headers(_sheets(v)))


@query
def mapping_confidence(v: Frames) -> DataFrame:
    return sheets.confidence(sheets.columns(sheets.headers(_sheets(v))))


@query
def sheet_fingerprints(v: Frames) -> DataFrame:
    """A key for the set of a sheet's headers, for finding a known layout again."""
    keys = F.array_sort(F.array_distinct(F.filter(F.transform("header", T.header_key), lambda k: k != "")))
    return sheets.headers(_sheets(v)).select("sheet", F.substring(F.sha1(F.array_join(keys, "|").cast("binary")), 1, 16).alias("fingerprint"), F.size(keys).alias("headers"))


def _wild(v: Frames) -> DataFrame:
    return v["v_wild"].select("sheet", "row_no", F.split("cells_text", r"\|").alias("cells"))


def _found(v: Frames) -> DataFrame:
    return written(tables.regions(_wild(v)))


def _whole(name: str, times: int, of: str) -> Column:
    """A double as a whole number of hundredths or thousandths."""
    return F.floor(F.col(of) * times + 0.5).cast("long").alias(name)


@query
def table_regions(v: Frames) -> DataFrame:
    return tables.regions(_wild(v)).select("sheet", "header_row", "hits", "first_col", "last_col", "header_rows", F.array_join("header", "|").alias("header"))


@query
def table_rows(v: Frames) -> DataFrame:
    rows = tables.data_rows(_wild(v), _found(v))
    return rows.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_no").alias("row_numbers"), F.sum(F.size(F.filter("cells", lambda c: c != ""))).alias("filled"))


@query
def column_looks(v: Frames) -> DataFrame:
    """What each column's cells look like, with a score."""
    seen = written(mapping.profile(mapping.samples(tables.data_rows(_wild(v), _found(v)))))
    return seen.select("sheet", "column", F.inline("looks_like")).select("sheet", "column", "field", _whole("hundredths", 100, "score"))


def _learned(v: Frames) -> DataFrame:
    """Headers of the tidier sheets, whose mapping is taken as confirmed."""
    known = written(sheets.headers(_sheets(v)))
    return written(mapping.learned_headers(sheets.columns(known), known))


def _mapped(v: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables found, their data rows and what their columns are."""
    found = _found(v)
    rows = written(tables.data_rows(_wild(v), found))
    return found, rows, mapping.mapped(found, rows, _learned(v))


@query
def column_mapping(v: Frames) -> DataFrame:
    return _mapped(v)[2].select("sheet", "column", "field", _whole("hundredths", 100, "score"), "tier")


@query
def header_learning(v: Frames) -> DataFrame:
    return _learned(v)


@query
def replayed_mapping(v: Frames) -> DataFrame:
    """Mappings confirmed on some sheets, replayed on all of the same layout, with columns that a user has set."""
    found, rows, mapped = _mapped(v)
    kept = mapping.templates_of(mapped.where("sheet % 4 = 1 and field <> 'notes'"), found)
    pin = lambda field, column: F.struct(F.lit(field).alias("field"), F.lit(column).alias("column"))
    pins = F.inline(F.array(pin("notes", 0), pin("dnp", -1)))
    forced = found.where("sheet % 5 = 0").select("sheet", pins)
    got = mapping.mapped(found, rows, _learned(v), written(kept), forced)
    return got.select("sheet", "column", "field", _whole("hundredths", 100, "score"), "tier")


def _together(v: Frames, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Ten sheets are a workbook."""
    names = found.select("sheet", F.when(F.col("sheet") % 3 == 0, "BOM main").when(F.col("sheet") % 3 == 1, "Sheet1").otherwise("old backup").alias("name"))
    return tables.compatible(tables.layouts(found), F.floor(F.col("sheet") / 10), tables.quality(found, rows, names))


def _typed(v: Frames) -> tuple[DataFrame, DataFrame, DataFrame]:
    found, rows, mapped = _mapped(v)
    plans = written(normalise.sheet_plans(found, mapped))
    return found, rows, normalise.typed(written(normalise.texts(rows, plans)), plans)


@query
def typed_lines(v: Frames) -> DataFrame:
    got = _typed(v)[2]
    issues_text = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["code"], i["severity"])), ",").alias("issues")
    lists = [F.array_join(c, ",").alias(c) for c in ("alt_mpns", "refs")]
    return got.select("sheet", "row_no", "line_no", "mpn", "manufacturer", "internal_pn", "description", "distributor", "distributor_pn", "value", "package", "tolerance", "notes", "level", *lists, "dnp", "quantity", (F.col("unit_price") * 1_000_000).cast("long").alias("price_micro"), "currency", issues_text)


@query
def united_lines(v: Frames) -> DataFrame:
    found, rows, got = _typed(v)
    return normalise.united(got, written(_together(v, found, rows))).select("workbook", "sheet", "row_no", "line_no", "mpn", "quantity")


@query
def layouts_alike(v: Frames) -> DataFrame:
    return tables.alike(tables.layouts(_found(v))).select("layout", "other", "shared", _whole("similarity", 1000, "similarity"))


@query
def compatible_sheets(v: Frames) -> DataFrame:
    found = _found(v)
    return _together(v, found, tables.data_rows(_wild(v), found)).select("workbook", "sheet", "best", _whole("similarity", 1000, "similarity"))


def _proposed(v: Frames) -> DataFrame:
    """Completions of lines with gaps that the catalogue knows."""
    matched = match.classify(lines.keyed(v["v_gap_line"].withColumns({"ref_text": F.lit(""), "dnp": F.lit(False), "quantity": F.lit(1.0)})), analysis.catalogue_of(v["v_part"]), v["v_offer"])
    gaps = v["v_gap_line"].join(matched.select("bom_id", "source_row", "part_id", "confidence"), ["bom_id", "source_row"])
    return written(completions.proposals(written(gaps), v["v_known_part"]))


@query
def completion_proposals(v: Frames) -> DataFrame:
    return _proposed(v)


@query
def completed_lines(v: Frames) -> DataFrame:
    """Lines after the completions that are 80 sure or more."""
    got = completions.applied(v["v_gap_line"], _proposed(v), least=80)
    return got.select("bom_id", "source_row", *completions.FIELDS, "filled", F.array_join(F.array_sort(F.map_keys("origin")), ",").alias("fields"))


@query
def payload_records(v: Frames) -> DataFrame:
    """Records in nested answers with what their parameters say of compliance."""
    got = records.records(v["v_payload"], "part_id").withColumn("mpn", F.coalesce(*[F.try_variant_get("record", f"$.{m}", "string") for m in C.RECORD_MARKERS]))
    got = got.withColumn("c", records.compliance(records.specs(F.col("record"))))
    return got.select("part_id", "depth", F.array_join("path", "/").alias("path"), "mpn", *[F.col(f"c.{f}").alias(f) for f in ("rohs", "rohs_note", "reach", "reach_note", "msl", "hts_code", "country_of_origin")])


def _observed(v: Frames) -> DataFrame:
    """Users stand for parts; views and clicks for snapshots, other events for facts."""
    return v["events"].select(F.col("user_id").alias("part_id"), F.when(F.col("event_type").isin("view", "click"), "snapshot").otherwise("fact").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


@query
def stale_marks(v: Frames) -> DataFrame:
    got = staleness.stale_marks(_observed(v), "2024-01-25 00:00:00")
    return got.select("part_id", "kind", F.col("stale_at").cast("timestamp_ntz").alias("stale_at"))


@query
def parts_to_fetch(v: Frames) -> DataFrame:
    parts = v["v_part"].select("part_id", (F.col("part_id") % 17 == 0).alias("forced"))
    return staleness.needs_fetch(parts, _observed(v).where("ts < timestamp '2024-01-20'"), "2024-01-20 00:00:00")

"""Events from nested registry records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinlake.functions import dates, text

RECORD = "firstDate string, carInfoChanges array<struct<date:string,carNo:string>>, ownerChanges array<string>, accidents array<struct<date:string,type:string,partCost:double,laborCost:double,paintingCost:double,insuranceBenefit:double>>, totalLossCnt int, totalLossDate string, floodTotalLossCnt int, floodPartLossCnt int, floodDate string, robberCnt int, business string, government string, loan string, notJoinDate1 string, notJoinDate2 string, notJoinDate3 string"


def record_events(df: DataFrame, key: str = "vehicle_id", raw: str = "raw") -> DataFrame:
    """(key, event_type, description, metadata, occurred_at) of registry records, which are JSON text (E36): first delivery, changes of owner (numbered by date), accidents,
    total and flood losses with a count above 0, thefts, uses and insurance gaps. Broken JSON gives no events; entries without a date have a null one."""
    r = df.select(F.col(key).alias(key), F.from_json(raw, RECORD).alias("r"))
    day = lambda c: F.to_timestamp_ntz(dates.day(c), F.lit("yyyy-MM-dd"))

    def event(rows: DataFrame, kind: str, desc, at, **fields) -> DataFrame:
        meta = F.to_json(F.struct(F.lit("registry").alias("source"), *(v.alias(k) for k, v in fields.items())))
        return rows.select(key, F.lit(kind).alias("event_type"), desc.alias("description"), meta.alias("metadata"), at.alias("occurred_at"))

    plates = r.select(key, F.explode(F.filter("r.carInfoChanges", lambda x: x.isNotNull())).alias("x")).select(key, F.col("x.date").alias("date"), F.col("x.carNo").alias("plate"))
    bare = r.select(key, F.explode("r.ownerChanges").alias("date")).select(key, "date", F.lit(None).cast("string").alias("plate")).filter("date IS NOT NULL")
    owners = plates.unionByName(bare)
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("date").asc_nulls_last(), F.col("plate").asc_nulls_last()))
    owners = owners.withColumns({"n": n, "of": F.count(F.lit(1)).over(Window.partitionBy(key))})
    hits = r.select(key, F.explode(F.filter("r.accidents", lambda x: x.isNotNull())).alias("x")).select(key, "x.*")
    mine = F.when(F.col("type").isin("1", "2"), "Own vehicle damage").otherwise("Damage to another vehicle")
    gaps = r.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("value")) for f in ("notJoinDate1", "notJoinDate2", "notJoinDate3")))).alias("x")).filter("trim(x.value) <> ''")
    uses = r.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("value")) for f in ("business", "government", "loan")))).alias("x")).filter("x.value = '1'")
    none = F.lit(None).cast("timestamp_ntz")
    parts = [
        event(r.filter("r.firstDate IS NOT NULL"), "delivery", F.concat(F.lit("First registration: "), "r.firstDate"), day(F.col("r.firstDate")), field=F.lit("firstDate"), value=F.col("r.firstDate")),
        event(owners, "owner_change", F.concat(F.lit("Owner change "), F.col("n"), F.lit(" of "), F.col("of")), day(F.col("date")), sequence=F.col("n"), total=F.col("of"), plate=F.col("plate")),
        event(hits, "accident", mine, day(F.col("date")), partCost=F.col("partCost"), laborCost=F.col("laborCost"), paintingCost=F.col("paintingCost"), insuranceBenefit=F.col("insuranceBenefit"), type=F.col("type")),
        event(r.filter("r.totalLossCnt > 0"), "total_loss", F.concat(F.lit("Total loss: "), F.col("r.totalLossCnt")), day(F.col("r.totalLossDate")), totalLossCnt=F.col("r.totalLossCnt")),
        event(r.filter("coalesce(r.floodTotalLossCnt, 0) + coalesce(r.floodPartLossCnt, 0) > 0"), "flood_damage", F.lit("Flood damage"), day(F.col("r.floodDate")), floodTotalLossCnt=F.col("r.floodTotalLossCnt")),
        event(r.filter("r.robberCnt > 0"), "other", F.concat(F.lit("Theft: "), F.col("r.robberCnt")), none, field=F.lit("theft")),
        event(uses, "other", F.concat(F.initcap("x.field"), F.lit(" use")), none, field=F.col("x.field")),
        event(gaps, "other", F.concat(F.lit("Insurance coverage gap: "), F.col("x.value")), none, field=F.col("x.field")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _node(depth: int) -> str:
    """The schema of an inspection's node with so many levels below it."""
    below = f", children:array<{_node(depth - 1)}>" if depth else ""
    return f"struct<type:struct<title:string>, statusType:struct<title:string>, statusTypes:array<struct<title:string>>{below}>"


LEVELS = 3
INSPECTION = f"recordNo string, issueDate string, validityStartDate string, validityEndDate string, mileage string, outers array<{_node(LEVELS)}>, inners array<{_node(LEVELS)}>"
DIAGNOSIS = "diagnosisNo string, realDiagnosisDate string, diagnosisDate string, items array<struct<name:string, partName:string, resultCode:string, result:string>>"
#: Items of a diagnosis that hold remarks instead of panels.
REMARKS = ("CHECKER_COMMENT", "OUTER_PANEL_COMMENT")


def _panel_json(label: Column, code: Column, result: Column, area: Column) -> Column:
    return F.struct(label.alias("label"), code.alias("resultCode"), result.alias("result"), area.alias("area"))


def inspection_events(df: DataFrame, key: str = "vehicle_id", raw: str = "raw") -> DataFrame:
    """(key, event_type, description, metadata, occurred_at): an inspection event for each report that is JSON text (E36), with the marked panels of its tree in its
    metadata (outers outside, inners inside, LEVELS levels of children), its number, dates and reading. Broken JSON and reports without a number or date give none."""
    r = df.select(F.col(key).alias(key), F.from_json(raw, INSPECTION).alias("r")).filter("r.recordNo IS NOT NULL OR r.issueDate IS NOT NULL")

    def panels(nodes: Column, area: str, depth: int) -> Column:
        def one(x: Column) -> Column:
            label = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x["type"]["title"], r"\(\s*\)", ""), r"[/|\s]+", " ")), F.lit(""))
            return _panel_json(label, F.lit(None).cast("string"), F.coalesce(x["statusType"]["title"], F.get(x["statusTypes"], F.lit(0))["title"]), F.lit(area))

        here = F.transform(F.coalesce(nodes, F.array().cast(f"array<{_node(depth)}>")), one)
        return here if not depth else F.concat(here, panels(F.flatten(F.filter(F.transform(F.coalesce(nodes, F.array().cast(f"array<{_node(depth)}>")), lambda x: x["children"]), lambda c: c.isNotNull())), area, depth - 1))

    found = F.filter(F.concat(panels(F.col("r.outers"), "exterior", LEVELS), panels(F.col("r.inners"), "interior", LEVELS)), lambda p: p["label"].isNotNull() & text.mark(F.lit(None).cast("string"), p["result"]).isNotNull())
    meta = F.to_json(F.struct(F.lit("inspection").alias("source"), *(F.col(f"r.{n}").alias(n) for n in ("recordNo", "issueDate", "validityStartDate", "validityEndDate")), F.regexp_replace("r.mileage", r"[^\d.]", "").try_cast("double").alias("mileageKm"), found.alias("panels")))
    at = F.to_timestamp_ntz(F.coalesce(dates.day(F.col("r.issueDate")), dates.day(F.col("r.validityStartDate"))), F.lit("yyyy-MM-dd"))
    return r.select(key, F.lit("inspection").alias("event_type"), F.concat_ws(" ", F.lit("Inspection report"), "r.recordNo").alias("description"), meta.alias("metadata"), at.alias("occurred_at"))


def diagnosis_events(df: DataFrame, key: str = "vehicle_id", raw: str = "raw") -> DataFrame:
    """(key, event_type, description, metadata, occurred_at): a diagnosis event for each report with items (E36): marked panels and remarks in its metadata, and allClear
    if all its panels are well."""
    r = df.select(F.col(key).alias(key), F.from_json(raw, DIAGNOSIS).alias("r")).filter(F.size("r.items") > 0)
    name = lambda x: F.coalesce(x["name"], x["partName"])
    items = F.filter("r.items", lambda x: name(x).isNotNull() & ~name(x).isin(*REMARKS))
    marked = F.transform(F.filter(items, lambda x: text.mark(x["resultCode"], x["result"]).isNotNull()), lambda x: _panel_json(name(x), x["resultCode"], x["result"], F.lit("exterior")))
    remarks = F.transform(F.filter("r.items", lambda x: name(x).isin(*REMARKS) & x["result"].isNotNull()), lambda x: x["result"])
    meta = F.to_json(F.struct(F.lit("diagnosis").alias("source"), F.col("r.diagnosisNo").alias("diagnosisNo"), marked.alias("panels"), remarks.alias("comments"), ((F.size(items) > 0) & (F.size(marked) == 0)).alias("allClear")))
    at = F.to_timestamp_ntz(dates.day(F.coalesce("r.realDiagnosisDate", "r.diagnosisDate")), F.lit("yyyy-MM-dd"))
    return r.select(key, F.lit("inspection").alias("event_type"), F.lit("Diagnosis").alias("description"), meta.alias("metadata"), at.alias("occurred_at"))

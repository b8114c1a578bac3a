"""State objects that pages hold in their scripts, cut out by a scan of brackets, and what can be read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.functions.urls import junk_picture, picture

#: A text in pieces: strings with their escapes, brackets, and runs of anything else. Together the pieces are the whole text.
PIECES = r'(?s)"(?:[^"\\]|\\.)*+"|[{\[]|[}\]]|[^"{}\[\]]++|"'
#: What stands before an object that a script assigns: window.NAME =, self["NAME"] =, var NAME =, NAME =
ASSIGNED = r"""(?:\b(?:window|self|globalThis)\s*(?:\.\s*|\[\s*["']))?([A-Za-z_$][A-Za-z0-9_$]*)(?:["']\s*\])?\s*=\s*(?=[{\[])"""
SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"


def balanced_length(text: Column) -> Column:
    """The length of the object or array that a text begins with; null if it begins with neither, or the brackets don't close. Brackets in strings don't count.

    One pass over the text's pieces; only the depth and the length so far are kept, so a large object costs no more than its length."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)
        over = (s["depth"] == 0) & (s["at"] > 0)
        return F.struct(F.when(over, 0).otherwise(depth).alias("depth"), F.when(over, s["at"]).otherwise(s["at"] + F.length(piece)).alias("at"))

    end = F.aggregate(F.regexp_extract_all(text, F.lit(PIECES), 0), start, step)
    return F.when(F.substring(text, 1, 1).isin("{", "["), F.when(end["depth"] == 0, end["at"]))


def _assigned(body: Column) -> Column:
    """array<struct<name, text>>: for each assignment of a script the rest of the script from its object on."""
    heads, names, between = F.regexp_extract_all(body, F.lit(ASSIGNED), 0), F.regexp_extract_all(body, F.lit(ASSIGNED), 1), F.split(body, ASSIGNED)
    ends = F.aggregate(
        F.arrays_zip(heads.alias("h"), F.slice(between, 1, F.size(heads)).alias("b")), F.array().cast("array<int>"), lambda at, x: F.concat(at, F.array(F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0)) + F.length(x["b"]) + F.length(x["h"])))
    )
    return F.transform(F.arrays_zip(names.alias("n"), ends.alias("e")), lambda x: F.struct(x["n"].alias("name"), x["e"].alias("at"), F.substr(body, x["e"] + 1).alias("text")))


def page_states(df: DataFrame, html: str, *keep: str) -> DataFrame:
    """(keep..., script, pos, name, state): every object or array in JSON that a page's scripts assign or consist of, as text.

    A script of a JSON type, or with an id, is taken whole and named by its id, else its type. Otherwise each assignment gives what its brackets enclose. What is no JSON
    is left out, and so are assignments inside an object that was taken."""
    attrs, bodies = (F.regexp_extract_all(html, F.lit(SCRIPT), i) for i in (1, 2))
    scripts = df.filter(F.contains(F.lower(html), F.lit("<script"))).select(*keep, F.posexplode(F.arrays_zip(attrs.alias("a"), bodies.alias("b"))).alias("script", "x")).select(*keep, "script", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    kind, own = (F.nullif(F.regexp_extract("a", rf"""(?i)\b{n}\s*=\s*["']?([^"'\s>]+)""", 1), F.lit("")) for n in ("type", "id"))
    whole = F.array(F.struct(F.coalesce(own, kind, F.lit("script")).alias("name"), F.lit(0).alias("at"), F.trim(F.regexp_replace("b", r"^\s+|\s+$", "")).alias("text")))
    is_json = F.coalesce(kind.rlike("(?i)json"), F.lit(False)) | F.coalesce(own.isNotNull() & F.ltrim("b").rlike(r"^\s*[{\[]"), F.lit(False))
    found = scripts.select(*keep, "script", F.posexplode(F.when(is_json, whole).otherwise(_assigned(F.col("b")))).alias("pos", "s"))
    found = found.select(*keep, "script", "pos", "s.name", "s.at", "s.text").withColumn("n", balanced_length(F.col("text")))
    found = found.select(*keep, "script", "pos", "name", "at", F.when(F.col("n").isNotNull(), F.substr("text", F.lit(1), F.col("n"))).alias("state"))
    ok = found.filter(F.try_parse_json("state").isNotNull())
    # An assignment inside another's object stands in a string of it: of a script's objects the outer ones, by the farthest end so far.
    per = F.array_sort(F.collect_list(F.struct("at", "pos", "name", "state")))
    outer = F.aggregate(per, F.array().cast("array<struct<at:int,pos:int,name:string,state:string>>"), lambda got, x: F.when(F.coalesce(F.try_element_at(got, F.lit(-1))["at"] + F.length(F.try_element_at(got, F.lit(-1))["state"]), F.lit(0)) > x["at"], got).otherwise(F.concat(got, F.array(x))))
    return ok.groupBy(*keep, "script").agg(outer.alias("o")).select(*keep, "script", F.explode("o").alias("o")).select(*keep, "script", "o.pos", "o.name", "o.state")


def at_path(state: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path such as "page.items.0.title"; null where there is none, or of another kind."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.try_variant_get(F.try_parse_json(state), f"${steps}", kind)


PICTURE = r"""(?i)(?:https?:)?//[^"'\\\s>]+\.(?:jpe?g|webp|png)(?:\?[^"'\\\s>]*)?"""


def harvested_pictures(df: DataFrame, html: str, *keep: str, hint: str | None = None, most: int = 40) -> DataFrame:
    """(keep..., pos, url): the pictures that a page names anywhere, scripts included (S14): each shot once, in its largest size, in the order in which shots first
    come; with a hint only those whose address holds it. keep must name a page. `most` shots a page, of the first 4 * most."""
    text = F.replace(F.replace(F.col(html), F.lit("\\u002F"), F.lit("/")), F.lit("\\/"), F.lit("/"))
    rows = df.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(PICTURE), 0)).alias("pos", "u"))
    rows = rows.withColumn("u", F.regexp_replace(F.regexp_replace("u", r"\?.*$", ""), "^//", "https://")).filter(~junk_picture(F.col("u")))
    width, height = (F.regexp_extract("u", r"(?:^|[^0-9])(\d{2,4})x(\d{2,4})(?:[^0-9]|$)", i).try_cast("int") for i in (1, 2))
    named = F.when(F.col("u").rlike("(?i)[/_-](?:thumb|thumbs|small|preview)(?:[/_.-]|$)"), -1).when(F.col("u").rlike("(?i)[/_-](?:large|orig|original)(?:[/_.-]|$)"), 1).otherwise(0)
    size = F.struct(named.alias("named"), F.coalesce(width * height, F.lit(0)).alias("area"), (-F.col("pos")).alias("first"))
    shots = rows.groupBy(*keep, picture(F.col("u")).alias("shot")).agg(F.min("pos").alias("pos"), F.max_by("u", size).alias("url"))
    per = F.array_sort(F.collect_list(F.struct("pos", "url")))
    shots = shots.groupBy(*keep).agg(F.slice(per, 1, 4 * most).alias("s"))
    picked = F.filter("s", lambda x: F.contains(F.lower(x["url"]), F.lit(hint.lower()))) if hint else F.col("s")
    return shots.select(*keep, F.posexplode(F.slice(picked, 1, most)).alias("pos", "x")).select(*keep, "pos", F.col("x.url").alias("url"))

"""Recorded answers of stock catalogues to normalised stock rows. Input: one JSON document per row in column `body`."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import parse_date

COLUMNS = ["source", "source_id", "title", "tags", "author", "author_url", "page_url", "licence", "licence_url", "published_at",
           "date_kind", "gps_lat", "gps_lon", "duration", "width", "height", "preview_url", "renditions"]
RENDITIONS = "map<string,struct<url:string,w:int,h:int,size:bigint>>"


def _finish(df: DataFrame, **cols) -> DataFrame:
    kinds = {"gps_lat": "double", "gps_lon": "double", "duration": "double", "width": "int", "height": "int", "renditions": RENDITIONS}
    out = {c: cols.get(c, F.lit(None) if c in kinds or c == "published_at" else F.lit("")) for c in COLUMNS}
    return df.select(*[v.cast(kinds.get(c, "string")).alias(c) for c, v in out.items()])


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _untag(c: Column) -> Column:
    return F.trim(F.regexp_replace(_blank(c), "<[^>]+>", ""))


def normalise_hits(raw: DataFrame) -> DataFrame:
    """Video-hit answers ({hits: [...]}): generated, low-quality, very short or picture-less hits are left out."""
    video = "struct<url:string,width:int,height:int,size:bigint,thumbnail:string>"
    schema = (f"struct<hits:array<struct<id:string,tags:string,user:string,userURL:string,pageURL:string,duration:double,"
              f"isAiGenerated:boolean,isLowQuality:boolean,videos:map<string,{video}>>>>")
    h = raw.select(F.explode(F.from_json("body", schema)["hits"]).alias("h"))
    v = F.col("h.videos")
    small = F.coalesce(F.try_element_at(v, F.lit("tiny")), F.try_element_at(v, F.lit("small")))
    h = h.withColumn("s", small).where(
        ~F.coalesce("h.isAiGenerated", F.lit(False)) & ~F.coalesce("h.isLowQuality", F.lit(False))
        & (_blank(F.col("s.thumbnail")) != "") & (F.coalesce("h.duration", F.lit(0.0)) >= 2))
    tags = _blank(F.col("h.tags"))
    rend = F.transform_values(F.map_filter(v, lambda _, x: _blank(x["url"]) != ""), lambda _, x: F.struct(
        x["url"].alias("url"), x["width"].alias("w"), x["height"].alias("h"), x["size"].alias("size")))
    return _finish(h, source=F.lit("pixabay"), source_id=F.col("h.id"), title=F.array_join(F.slice(F.split(tags, ", "), 1, 3), ", "),
                   tags=tags, author=_blank(F.col("h.user")), author_url=_blank(F.col("h.userURL")), page_url=_blank(F.col("h.pageURL")),
                   licence=F.lit("Pixabay Content License"), licence_url=F.lit("https://pixabay.com/service/license-summary/"),
                   date_kind=F.lit("unknown"), duration=F.col("h.duration"), width=F.col("s.width"), height=F.col("s.height"),
                   preview_url=F.col("s.thumbnail"), renditions=rend)


def normalise_pages(raw: DataFrame) -> DataFrame:
    """Wiki file pages ({query: {pages: [...]}}): recorded date if given, else upload date; coordinates; tags stripped."""
    meta = "map<string,struct<value:string>>"
    info = (f"struct<url:string,thumburl:string,descriptionurl:string,timestamp:string,mime:string,size:bigint,duration:double,"
            f"width:int,height:int,extmetadata:{meta}>")
    schema = (f"struct<query:struct<pages:array<struct<pageid:string,title:string,imageinfo:array<{info}>,"
              f"coordinates:array<struct<lat:double,lon:double>>>>>>")
    p = raw.select(F.explode(F.from_json("body", schema)["query"]["pages"]).alias("p"))
    p = p.withColumn("i", F.get("p.imageinfo", F.lit(0))).where((_blank(F.col("i.thumburl")) != "") & (F.coalesce("i.duration", F.lit(0.0)) >= 2))
    m = lambda k: F.try_element_at(F.col("i.extmetadata"), F.lit(k))["value"]
    recorded, uploaded = parse_date(m("DateTimeOriginal")), parse_date(F.col("i.timestamp"))
    at = F.get("p.coordinates", F.lit(0))
    rend = F.create_map(F.lit("original"), F.struct(F.col("i.url").alias("url"), F.col("i.width").alias("w"), F.col("i.height").alias("h"),
                                                   F.coalesce("i.size", F.lit(0)).alias("size")))
    return _finish(p, source=F.lit("commons"), source_id=F.col("p.pageid"),
                   title=F.regexp_replace(F.regexp_replace("p.title", "^File:", ""), r"\.[^.]*$", ""),
                   tags=F.replace(_untag(m("Categories")), F.lit("|"), F.lit(", ")), author=F.substring(_untag(m("Artist")), 1, 80),
                   page_url=_blank(F.col("i.descriptionurl")), licence=_blank(m("LicenseShortName")), licence_url=_blank(m("LicenseUrl")),
                   published_at=F.coalesce(recorded, uploaded), date_kind=F.when(recorded.isNotNull(), "recorded").otherwise("upload"),
                   gps_lat=at["lat"], gps_lon=at["lon"], duration=F.col("i.duration"), width=F.col("i.width"), height=F.col("i.height"),
                   preview_url=F.col("i.thumburl"), renditions=rend)


def normalise_docs(raw: DataFrame) -> DataFrame:
    """Archive search answers ({response: {docs: [...]}}): creator and subject may be text or list; a default licence applies."""
    schema = ("struct<response:struct<docs:array<struct<identifier:string,title:string,date:string,creator:string,subject:string,"
              "licenseurl:string,item_size:bigint>>>>")
    d = raw.select(F.explode(F.from_json("body", schema)["response"]["docs"]).alias("d"))
    # a list arrives as its JSON text when read as string
    listed = lambda c: F.coalesce(F.array_join(F.when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>")), ", "), c, F.lit(""))
    ident = F.col("d.identifier")
    size = F.create_map(F.lit("item"), F.struct(F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("w"),
                                                F.lit(None).cast("int").alias("h"), F.coalesce("d.item_size", F.lit(0)).alias("size")))
    lic = F.when(_blank(F.col("d.licenseurl")) != "", F.col("d.licenseurl"))
    return _finish(d, source=F.lit("archive"), source_id=ident,
                   title=F.substring(F.coalesce(F.when(F.col("d.title") != "", F.col("d.title")), ident), 1, 120),
                   tags=listed(F.col("d.subject")), author=listed(F.col("d.creator")), page_url=F.concat(F.lit("https://archive.org/details/"), ident),
                   licence=F.coalesce(lic, F.lit("Public domain (Prelinger / Internet Archive)")), licence_url=_blank(lic),
                   published_at=parse_date(F.col("d.date")), date_kind=F.when(_blank(F.col("d.date")) != "", "recorded").otherwise("unknown"),
                   preview_url=F.concat(F.lit("https://archive.org/services/img/"), ident), renditions=size)


CONNECTORS = {"pixabay": normalise_hits, "commons": normalise_pages, "archive": normalise_docs}


def rendition_url(renditions: Column) -> Column:
    """Download address: small, else tiny, else medium."""
    url = lambda k: F.try_element_at(renditions, F.lit(k))["url"]
    return F.coalesce(*[F.when(url(k) != "", url(k)) for k in ("small", "tiny", "medium")])

"""Licences, orientation, time codes, geography, in-points."""
from pyspark.sql import Column, functions as F

from . import fixed


def licence_class(licence: Column, url: Column, source: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(licence, F.lit("")), F.coalesce(url, F.lit(""))))
    out = F.when(F.coalesce(source, F.lit("")).isin("", "own"), F.lit("own")).when(F.trim(text) == "", F.lit("unknown"))
    for name, needles in fixed.LICENCE_RULES:
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(text, F.lit(n))
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def is_commercial(cls: Column) -> Column:
    return cls.isin(*fixed.COMMERCIAL_CLASSES)


def credit_line(title: Column, author: Column, licence: Column, url: Column, page: Column) -> Column:
    lic = F.trim(F.coalesce(licence, F.lit("")))
    lic = F.when(F.startswith(lic, F.lit("http")), F.lit("Creative Commons licence")).otherwise(lic)
    who = F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit(" by "), author)).otherwise(F.lit(""))
    link = F.coalesce(F.when(page != "", page), F.when(url != "", url), F.lit(""))
    return F.trim(F.concat(F.lit("“"), title, F.lit("”"), who, F.lit(". "), lic, F.lit(". "), link))


def licence_card(licence: Column, url: Column, source: Column, title: Column, author: Column, page: Column) -> Column:
    cls = licence_class(licence, url, source)
    labels = F.create_map(*[x for k, v in fixed.LICENCE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    plain = (F.coalesce(licence, F.lit("")) != "") & ~F.startswith(F.coalesce(licence, F.lit("")), F.lit("http"))
    text = F.when(plain, licence).otherwise(F.coalesce(F.when(url != "", url), F.when(licence != "", licence), F.lit("")))
    return F.struct(
        cls.alias("class"), labels[cls].alias("label"), is_commercial(cls).alias("commercial"), text.alias("text"),
        F.coalesce(url, F.lit("")).alias("url"),
        F.when(cls.isin("attribution", "caution"), credit_line(title, author, licence, url, page)).alias("credit"))


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h * 1.1, "16:9").when(h > w * 1.1, "9:16").otherwise("1:1")


def to_frames(sec: Column, fps=fixed.EXPORT_FPS) -> Column:
    return F.rint(sec * F.lit(float(fps)) if not isinstance(fps, Column) else sec * fps).cast("long")


def timecode(frames: Column, fps: int = fixed.EXPORT_FPS) -> Column:
    s = F.floor(frames / F.lit(fps))
    return F.concat_ws(":", *[padded(x, 2) for x in (F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, frames % F.lit(fps))])


def padded(number: Column, digits: int) -> Column:
    """A whole number of 0 or more as text with leading zeros; longer ones as they are. Much cheaper than format_string."""
    t = F.coalesce(number.cast("string"), F.lit("null"))
    return F.lpad(t, F.greatest(F.length(t), F.lit(digits)), F.lit("0"))


def timecode_seconds(c: Column, fps: int = fixed.EXPORT_FPS) -> Column:
    p = F.split(c, "[:;]")
    n = lambda k: F.get(p, F.lit(k)).try_cast("int")
    return n(0) * 3600 + n(1) * 60 + n(2) + n(3) / F.lit(float(fps))


def srt_time(sec: Column) -> Column:
    ms = F.rint(F.greatest(sec, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60,
                           F.floor(ms / 1000) % 60, ms % 1000)


def rate(fps: Column) -> Column:
    base = F.rint(fps).cast("int")
    return F.struct(base.alias("timebase"), (F.abs(fps - base) > 0.01).alias("ntsc"))


def haversine_km(la1: Column, lo1: Column, la2: Column, lo2: Column) -> Column:
    half = lambda x: F.pow(F.sin(x / 2), 2)
    a = half(F.radians(la2 - la1)) + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * half(F.radians(lo2 - lo1))
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def smart_trim(t0: Column, t1: Column, peak: Column, dur: Column) -> Column:
    """Start a clip so that its motion peak lands 40 % in, clamped to the shot."""
    start = F.least(F.greatest(peak - dur * 0.4, t0), t1 - dur)
    return F.when(peak.isNull() | ((t1 - t0) < dur + 1.0), t0).otherwise(start)


def source_in(t_in: Column, dur: Column, file_dur: Column) -> Column:
    """Slide the in-point back when the clip would run past the end of its file."""
    return F.when(t_in + dur > file_dur, F.greatest(F.lit(0.0), file_dur - dur)).otherwise(t_in)


def spot_weight(importance: Column, visual: Column) -> Column:
    return F.coalesce(importance, F.lit(0.0)) * (F.lit(0.4) + F.lit(0.6) * F.coalesce(visual, F.lit(0.0)))


def hook_seconds(dur: Column) -> Column:
    return F.bround(F.least(F.lit(fixed.HOOK_S), F.greatest(F.lit(0.5), F.coalesce(dur, F.lit(0.0)) * 0.1)), 2)


def min_slot_seconds(dur: Column) -> Column:
    return F.when(F.coalesce(dur, F.lit(0.0)) < 20, 1.0).otherwise(fixed.MIN_SLOT_S)

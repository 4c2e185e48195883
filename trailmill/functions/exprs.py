"""Column expressions shared by the operators. All are built-in expressions: they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0

#: Emoji ranges of log icons, for Java character classes.
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2300}-\\x{23FF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{203C}\\x{2049}\\x{2139}\\x{1F000}-\\x{1F2FF}]"
BOX = "[\\x{2500}-\\x{257F}]"
UUID = "(?i)\\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\b"


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Null instead of '' where nothing matches."""
    return none_if_empty(F.regexp_extract(c, pattern, group))


def strip_variation(c: Column) -> Column:
    """Without emoji variation selectors."""
    return F.translate(c, "︎️", "")


def shape(text: Column, size: int = 200) -> Column:
    """Text with ids and numbers masked, white space collapsed, cut: equal for messages that differ in values only."""
    t = F.regexp_replace(text, UUID, "«id»")
    t = F.regexp_replace(t, "-?\\d+(?:\\.\\d+)?", "#")
    t = F.trim(F.regexp_replace(t, "\\s+", " "))
    return F.left(t, F.lit(size))


def content_lines(lines: Column, n: int) -> Column:
    """The first n lines that hold a letter, without box-drawing decoration."""
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, BOX + "+", "")))
    return F.slice(F.filter(bare, lambda x: x.rlike("\\p{L}")), 1, n)


def severity(level: Column, icon: Column, platform: Column | None = None) -> Column:
    """'error', 'warning' or null: the union of what level and icon say."""
    icon = F.coalesce(icon, F.lit(""))
    level = F.coalesce(level, F.lit(""))
    cross = icon.contains("❌")
    if platform is not None:
        cross = cross & ((platform != "android") | (level == "ERROR"))
    error = (level == "ERROR") | icon.contains("‼") | cross
    return F.when(error, "error").when((level == "WARN") | icon.contains("⚠"), "warning")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    # least() skips nulls, so a missing position must be kept null here
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, as a double; for timestamps with or without zone."""
    return (_micros(b) - _micros(a)) / 1e6


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?\\[?([^/:?#\\]]*)", 1))


def url_class(url: Column) -> Column:
    """private-lan, cleartext-http, https-public or other."""
    host = url_host(url)
    private = host.rlike("^(?:localhost|127\\..*|10\\..*|192\\.168\\..*|172\\.(?:1[6-9]|2[0-9]|3[01])\\..*)$") | host.rlike("\\.(?:local|lan)$")
    low = F.lower(url)
    return (
        F.when(private, "private-lan").when(low.startswith("http://"), "cleartext-http").when(low.startswith("https://"), "https-public").otherwise("other")
    )


def urls(text: Column) -> Column:
    """URLs of a text, without punctuation at their end."""
    found = F.regexp_extract_all(text, F.lit("https?://[^\\s\"'<>)\\]}]+"), F.lit(0))
    return F.transform(found, lambda u: F.rtrim(u, F.lit(".;\"'")))


def version_key(version: Column, width: int = 4) -> Column:
    """Array of ints, padded with zeros, that compares as versions do; null for null."""
    nums = F.transform(F.regexp_extract_all(version, F.lit("\\d+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.when(version.isNotNull(), F.slice(F.concat(nums, F.array_repeat(F.lit(0), width)), 1, width))


def version_in(version: Column, low: Column, high: Column) -> Column:
    """Inclusive range; a null bound is open and a null version passes."""
    v = version_key(version)
    return F.coalesce(v >= version_key(low), F.lit(True)) & F.coalesce(v <= version_key(high), F.lit(True))


def iso_text(ts: Column) -> Column:
    """Space-separated ISO text, milliseconds cut."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def duration_ms(text: Column) -> Column:
    """'1d23h40m16s428ms' as milliseconds; null if there is no such part."""
    parts = [("d", 86_400_000), ("h", 3_600_000), ("m(?!s)", 60_000), ("s", 1000), ("ms", 1)]
    total, some = F.lit(0).cast("bigint"), F.lit(False)
    for unit, ms in parts:
        v = F.nullif(F.regexp_extract(text, f"(\\d+){unit}", 1), F.lit("")).try_cast("bigint")
        total, some = total + F.coalesce(v * ms, F.lit(0)), some | v.isNotNull()
    return F.when(some, total)


def number(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint").cast("double"), text.try_cast("double"))


def duration_text(seconds: Column) -> Column:
    """'42 s' below 90 s, '17.2 min' below 90 min, else '3.4 h'."""
    seconds = seconds.cast("double")
    return (
        F.when(seconds < 90, F.concat(F.format_string("%.0f", seconds), F.lit(" s")))
        .when(seconds < 5400, F.concat(F.format_string("%.1f", seconds / 60), F.lit(" min")))
        .otherwise(F.concat(F.format_string("%.1f", seconds / 3600), F.lit(" h")))
    )


def first_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines, and how many more there are; line breaks at the end don't count."""
    lines = F.split(F.regexp_replace(text, "[\\r\\n]+$", ""), "\r\n|\r|\n")
    more = F.size(lines) - n
    return F.when(more <= 0, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n… (+"), more.cast("string"), F.lit(" more lines)")))


def alias_letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA: bijective base 26, for every positive bigint."""
    # the letters are the digits, padded, of a number's place among names of its length
    shorter = [sum(26**i for i in range(1, k)) for k in range(1, 15)]
    digits, letters = "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    named = [F.translate(F.lpad(F.conv((n.cast("bigint") - 1 - s).cast("string"), 10, 26), k, "0"), digits, letters) for k, s in enumerate(shorter, 1)]
    out = named[-1]
    for one, most in reversed(list(zip(named, shorter[1:]))):
        out = F.when(n <= most, one).otherwise(out)
    return out


def balanced(raw: Column) -> Column:
    """True if braces balance and each box that opens also closes."""
    braces = F.regexp_count(raw, F.lit("\\{")) == F.regexp_count(raw, F.lit("\\}"))
    box = ~raw.contains("╔") | raw.contains("╚")
    return braces & box


def earliest_direction(text: Column, moving: list[str], stationary: list[str]) -> Column:
    """True if the first of all tokens says moving, False if it says stationary, else null."""
    at = lambda ts: F.least(*[F.nullif(F.instr(text, t), F.lit(0)) for t in ts], F.lit(None).cast("int"))
    m, s = at(moving), at(stationary)
    return F.when(m.isNull() & s.isNull(), None).otherwise(F.coalesce(m < s, s.isNull()))


def circle(lat: str, lon: str, radius_m: str, corners: int = 32) -> Column:
    """A closed ring of (lon, lat) at a distance on the sphere around a position."""
    at, r = F.radians(F.col(lat)), F.col(radius_m) / 6371000.0

    def corner(i):
        a = F.radians(i * 360.0 / corners)
        y = F.asin(F.sin(at) * F.cos(r) + F.cos(at) * F.sin(r) * F.cos(a))
        x = F.radians(F.col(lon)) + F.atan2(F.sin(a) * F.sin(r) * F.cos(at), F.cos(r) - F.sin(at) * F.sin(y))
        return F.array(F.round(F.degrees(x), 7), F.round(F.degrees(y), 7))

    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: corner(i % corners))


def speed_bucket(v: Column, bins: int = 8, top: float = 30.0) -> Column:
    """Bucket 0..bins-1 of a speed; -1 for null."""
    b = F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(top - 0.01)) / top * bins)
    return F.when(v.isNull(), -1).otherwise(F.least(F.lit(bins - 1), b)).cast("int")  # greatest() skips nulls


def mercator(lat: Column, lon: Column, zoom: Column) -> tuple[Column, Column]:
    """World pixel coordinates at a zoom level of 256-pixel tiles."""
    size = 256 * F.pow(F.lit(2.0), zoom)
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878))))
    return (lon + 180) / 360 * size, (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * 3.141592653589793)) * size


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return 156543.03392804097 * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def axis_step_s(span: Column, ticks: int = 9) -> Column:
    """The smallest of the usual steps that gives at most ``ticks`` ticks."""
    out = F.lit(86400 * 7)
    for step in (86400 * 2, 86400, 43200, 21600, 10800, 7200, 3600, 1800, 900, 600, 300, 120, 60, 30, 15, 10, 5, 1):
        out = F.when(span / step <= ticks, step).otherwise(out)
    return out


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def resolve_version(version: Column, builds: dict[str, str]) -> Column:
    """A version, or the one that a bare build number stands for; null (no filter) for a build that is not known."""
    known = F.lit(None).cast("string")
    for build, name in builds.items():
        known = F.when(version == build, name).otherwise(known)
    return F.when(version.rlike("^[0-9]+$"), known).otherwise(version)


def histogram_text(counts: Column, none: str = "none appear") -> Column:
    """'a×3, b×1' of an array of (key, n, first): most frequent first, then by first occurrence."""
    by = F.transform(counts, lambda x: F.struct((-x["n"]).alias("m"), x["first"].alias("first"), x["key"].alias("key")))
    parts = F.transform(F.array_sort(by), lambda x: F.concat(x["key"], F.lit("×"), (-x["m"]).cast("string")))
    return F.when(F.coalesce(F.size(counts), F.lit(0)) < 1, none).otherwise(F.array_join(parts, ", "))


def session_label(i: Column, of: Column, distance_m: Column, ended_by: Column) -> Column:
    km = F.when(distance_m >= 100, F.concat(F.format_string("%.1f", distance_m / 1000), F.lit(" km")))
    end = F.when(ended_by != "", F.concat(F.lit("ended by "), ended_by))
    return F.concat_ws(" · ", F.concat(F.lit("session "), i.cast("string"), F.lit(" of "), of.cast("string")), km, end)

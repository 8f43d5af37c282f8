"""Column to Column functions of the trend-signal domain. All are built-in expressions; raw input never raises."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsight.functions import fixed


def lookup(values: dict, key: Column) -> Column:
    """A literal map; null where the key is unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def any_token(c: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in tokens])


def strip(c: Column) -> Column:
    """Without white space at both ends, the ideographic space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Null where blank."""
    return F.nullif(strip(c), F.lit(""))


def normalize_text(c: Column) -> Column:
    """S-01, S-02: null to empty, runs of any white space to one space, trimmed."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def let(c: Column, f) -> Column:
    """``f`` of ``c``, which is evaluated once: a lambda's body would evaluate it for every element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unique(arr: Column) -> Column:
    """SET-04: ordered unique, first one kept."""
    return F.array_distinct(arr)


def unique_ignoring_case(arr: Column) -> Column:
    """SET-03: trimmed, blanks dropped, first spelling kept."""
    clean = F.filter(F.transform(arr, strip), lambda x: x != "")
    firsts = lambda c, low: F.filter(c, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return let(clean, lambda c: let(F.transform(c, F.lower), lambda low: firsts(c, low)))


def normalize_tags(c: Column) -> Column:
    """S-03."""
    return F.array_join(unique(F.filter(F.transform(F.split(normalize_text(c), "[，,、/|；;]"), strip), lambda x: x != "")), "|")


def normalize_timestamp(c: Column) -> Column:
    """S-04: year and month, or one of the usual forms, to ``yyyy-MM-dd HH:mm:ss``; blank where none fits."""
    t = normalize_text(c)
    month = F.when(t.rlike(r"^\d{6}$"), F.try_to_timestamp(F.concat(t, F.lit("01")), F.lit("yyyyMMdd")))
    forms = [F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd")]
    return F.coalesce(F.date_format(F.coalesce(month, *forms, F.try_to_timestamp(t)), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def price_band(c: Column) -> tuple[Column, Column]:
    """S-05: least and greatest of the first two figures; one figure is both."""
    n = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)")), lambda x: x.cast("double"))
    return F.get(n, F.lit(0)), F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0)))


def short_id(prefix: str, length: int, *parts: Column) -> Column:
    """S-06: a deterministic id of the parts."""
    return hashed_id(prefix, length, *[normalize_text(p) for p in parts])


def hashed_id(prefix: str, length: int, *parts: Column) -> Column:
    """S-06 of parts that are normalised already."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length))


def safe_int(c: Column) -> Column:
    """S-07: a whole number, else 0."""
    text = c.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint")), F.lit(0).cast("bigint"))


def first_int(c: Column) -> Column:
    """S-08: the first run of digits, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def engagement(liked: Column, collected: Column, comment: Column, share: Column) -> Column:
    """S-09."""
    return F.least(safe_int(liked) * 1.0 + safe_int(collected) * 2.0 + safe_int(comment) * 1.5 + safe_int(share) * 3.0, F.lit(10000.0))


def risk_of_topics(c: Column) -> Column:
    """S-11."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(any_token(low, fixed.RISK_HIGH), "high").when(any_token(low, fixed.RISK_MEDIUM), "medium").otherwise("low")


def analysis(title: Column, desc: Column, keyword: Column) -> tuple[Column, Column]:
    """S-12: summary and sentiment without a model."""
    merged = F.concat_ws(" ", filled(title), filled(desc))
    summary = F.when(merged != "", F.left(merged, F.lit(150))).otherwise(keyword)
    return summary, F.when(any_token(merged, fixed.NEGATIVE_HINTS), "negative").when(any_token(merged, fixed.POSITIVE_HINTS), "positive").otherwise("neutral")


def json_object(c: Column, schema: str) -> Column:
    """S-13: an object in plain text, in a code fence, or between the outermost braces."""
    bare = strip(F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    braces = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    whole = F.when(bare.startswith("{"), F.from_json(bare, schema, {"mode": "PERMISSIVE"}))
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull(), whole), F.when(F.try_parse_json(braces).isNotNull(), F.from_json(braces, schema)))


def source_url(raw: Column, source_id: Column, platform: Column) -> Column:
    """S-14: the first url in raw JSON, else a made-up one."""
    return F.coalesce(*[filled(F.get_json_object(raw, f"$.{k}")) for k in fixed.URL_KEYS], F.concat(F.lit("about:source/"), platform, F.lit("/"), source_id.cast("string")))


def signal_platform(c: Column) -> Column:
    """S-15, case kept."""
    return F.coalesce(lookup(fixed.SIGNAL_LABELS, c), c)


def platform_label(c: Column) -> Column:
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.coalesce(lookup(fixed.PLATFORM_LABELS, low), low)


def platform_code(c: Column) -> Column:
    label = platform_label(c)
    return F.coalesce(lookup(fixed.PLATFORM_CODES, label), label)


def due_platform(c: Column) -> Column:
    label = platform_label(c)
    return F.when(F.coalesce(c, F.lit("")) == "", None).when(lookup(fixed.PLATFORM_CODES, label).isNotNull(), label).otherwise(c)


def unit_key(keyword: Column, platform: Column, query: Column) -> Column:
    """S-16."""
    return F.concat_ws("__", *[F.lower(strip(c)) for c in (keyword, platform, query)])


def bucket_start(ts: Column, kind: str) -> Column:
    """S-17: half days for ``12h``, else days."""
    day = F.date_trunc("day", ts)
    return F.when(F.hour(ts) >= 12, day + F.expr("interval 12 hours")).otherwise(day) if kind == "12h" else day


def tier(priority: Column, goal: Column) -> Column:
    """S-18."""
    return F.when((goal == "risk_monitoring") | (priority == "high"), "watchlist-hot").when(priority == "low", "discovery").otherwise("watchlist-normal")


def tier_minutes(tier_name: Column, code: Column) -> tuple[Column, Column]:
    """Revisit and cooldown."""
    get = lambda k: F.coalesce(lookup({t: v[k] for t, v in fixed.TIERS.items()}, tier_name), F.lit(fixed.TIERS["watchlist-normal"][k]))
    xhs = code == "xhs"
    return F.when(xhs, get(1)).otherwise(get(0)), F.when(xhs, get(3)).otherwise(get(2))


def retryable(c: Column) -> Column:
    """S-19."""
    return any_token(F.lower(F.coalesce(c, F.lit(""))), fixed.RETRYABLE)


def policy(default: dict, platform: dict, overrides: dict) -> dict:
    """S-20: the profile's values, then the platform's, then those overrides that are set."""
    return {**default, **platform, **{k: v for k, v in overrides.items() if v is not None}}


def resolved_policy(profiles: dict[str, dict], platform: str, profile: str, overrides: dict | None = None) -> dict:
    """S-20: the policy of a platform under a named profile, with both names; an unknown profile is an error."""
    if profile not in profiles:
        raise ValueError(f"no profile {profile}; one of {', '.join(profiles)}")
    held = profiles[profile]
    return {**policy(held.get("default", {}), held.get(platform, {}), overrides or {}), "platform": platform, "profile_name": profile}


#: S-10: letters that a text keeps at most, by what it is for. Fixed values.
LETTERS = {"title": 500, "desc": 1000, "summary": 150, "evidence": 800}


def kept_letters(c: Column, use: str) -> Column:
    """S-10: a text cut to the letters its use allows; null stays null."""
    return F.left(c, F.lit(LETTERS[use]))


def parse_time(c: Column, missing: Column) -> Column:
    """S-21: ISO text; naive is UTC; what does not parse is ``missing``."""
    return F.coalesce(F.try_to_timestamp(c), missing)


def wall_clock(c: Column) -> Column:
    """S-22: the offset is dropped, not applied."""
    return F.regexp_replace(c, r"(?:Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")


def unix_text(c: Column) -> Column:
    """S-23: seconds or milliseconds to ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.when(c > 1_000_000_000_000, F.timestamp_millis(c)).otherwise(F.timestamp_seconds(c)), "yyyy-MM-dd HH:mm:ss")


def unix_of(c: Column) -> Column:
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0).cast("bigint"))


def rfc2822(c: Column) -> tuple[Column, Column]:
    """S-24: seconds of an RFC 2822 text, right, and as the domain has them (wall clock taken for UTC)."""
    body = F.regexp_replace(c, r"^\w{3},?\s+", "")
    right = F.unix_timestamp(F.try_to_timestamp(body, F.lit("MMM dd HH:mm:ss Z yyyy")))
    wall = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(body, r"[+-]\d{4}", "+0000"), F.lit("MMM dd HH:mm:ss Z yyyy")))
    return right, wall


def html_text(c: Column) -> Column:
    """S-25: without script and style blocks and tags."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</\1>", ""), r"<[^>]+>", ""))


def inline_text(c: Column) -> Column:
    """S-26."""
    return F.regexp_replace(c, "<.*?>", "")


def url_params(c: Column) -> Column:
    """S-27: the last of equal names wins, blank values go."""
    query = F.regexp_extract(F.coalesce(c, F.lit("")), r"\?([^#]*)", 1)
    pairs = F.filter(F.transform(F.split(query, "&"), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.regexp_extract(p, "=(.*)$", 1).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.try_url_decode(p["v"]))))


def last_of(pairs: Column) -> Column:
    """Entries ``k, v`` of an array as a map: of equal names the last wins, those without a name go."""
    named = F.filter(pairs, lambda p: p["k"].isNotNull())
    return F.map_from_entries(F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda q: q["k"] == p["k"])))


def content_id(c: Column, patterns: dict[str, str], strict: bool = False) -> Column:
    """S-28: the id in a url by the first pattern that fits, or a bare id. Where none does: null, or an error if ``strict``."""
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns.values()]
    none = F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no id in "), c)).cast("string"))
    return F.coalesce(*found, F.when(c.rlike(r"^[A-Za-z0-9]+$"), c), *([none] if strict else []))


#: Id patterns by platform.
ID_PATTERNS = {"xhs": r"/(?:explore|discovery/item|item)/([0-9a-zA-Z]+)", "bili": r"/video/(BV[0-9A-Za-z]+)", "dy": r"/(?:video|note)/(\d+)", "dy_modal": r"modal_id=(\d+)", "ks": r"/short-video/([0-9a-zA-Z_-]+)"}


def zhihu_kind(c: Column) -> Column:
    """S-29."""
    return F.when(c.contains("/answer/"), "answer").when(c.contains("/p/"), "article").when(c.contains("/zvideo/"), "zvideo").otherwise("")


def paging_offset(c: Column) -> Column:
    return F.regexp_extract(c, r"offset=([^&]*)", 1)


def trace_id(c: Column) -> Column:
    """S-30: an image's last path segment, under ``spectrum/`` where the url is."""
    last = F.element_at(F.split(c, "/"), -1)
    return F.when(c.contains("spectrum"), F.concat(F.lit("spectrum/"), last)).otherwise(last)


#: S-30: hosts that serve an image by its trace id. Fixed values.
IMAGE_HOSTS = ("https://sns-img-qc.xhscdn.com", "https://sns-img-hw.xhscdn.com", "https://sns-img-bd.xhscdn.com", "https://sns-img-qn.xhscdn.com")


def image_urls(trace: Column, kind: str = "png") -> Column:
    """S-30: where an image is served, one url for each host in order."""
    return F.transform(F.array(*[F.lit(h) for h in IMAGE_HOSTS]), lambda h: F.concat(h, F.lit("/"), trace, F.lit(f"?imageView2/format/{kind}")))


def base36(c: Column) -> Column:
    """S-31."""
    return F.conv(c.cast("string"), 10, 36)


def from_base36(c: Column) -> Column:
    """S-31: of up to 12 digits, which any 64-bit number has; longer ones by ``from_base36_wide``, null here."""
    digits = F.regexp_replace(c, "^0+(?=.)", "")
    return F.when(F.length(digits) <= 12, F.conv(digits, 36, 10).cast("bigint"))


def from_base36_wide(c: Column) -> Column:
    """S-31: of up to 24 digits, as a decimal of 38 digits; null for more or for other characters."""
    digit = lambda x: F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), x) - 1
    wide = "decimal(38,0)"
    value = F.aggregate(F.split(F.lower(c), ""), F.lit(0).cast(wide), lambda n, x: (n * F.lit(36).cast("decimal(3,0)") + digit(x)).cast(wide))
    return F.when(c.rlike("^[0-9A-Za-z]{1,24}$"), value)


def state_text(c: Column, marker: str) -> Column:
    """S-34: the JSON text behind a marker in a page, up to the end of its script; ``undefined`` as a value becomes null."""
    raw = F.regexp_extract(c, rf"(?s){marker}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    return F.regexp_replace(raw, r"(?<=[:,\[])\s*undefined\s*(?=[,}\]])", "null")


def state_json(c: Column, marker: str) -> Column:
    """S-34: such JSON as a variant, null where it is none."""
    return F.try_parse_json(state_text(c, marker))


def script_json(c: Column, element: str) -> Column:
    """S-34: the JSON of the script element of that id, as a variant."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, rf"(?s)<script[^>]*\bid=[\"']{element}[\"'][^>]*>(.*?)</script>", 1), F.lit("")))


def decamelized(c: Column) -> Column:
    """S-34: JSON text with its names in lower case and underscores; values stay as they are."""
    for k in range(26):
        big, small = chr(65 + k), chr(97 + k)
        # within a name: behind a small letter or digit, up to the quote and colon
        c = F.regexp_replace(c, rf'(?<=[a-z0-9]){big}(?=[A-Za-z0-9_]*"\s*:)', f"_{small}")
    for k in range(26):
        c = F.regexp_replace(c, rf'{chr(65 + k)}(?=[A-Za-z0-9_]*"\s*:)', chr(97 + k))
    return c


def last_url(arr: Column) -> Column:
    """S-35."""
    return F.try_element_at(arr, F.lit(-1))


def first_filled(*arrays: Column, pick: int = -1) -> Column:
    """S-35: of the first array that has entries the one at ``pick``, the last by default; null if none has any, or not so many."""
    return F.coalesce(*[F.try_element_at(F.filter(a, lambda x: filled(x).isNotNull()), F.lit(pick)) for a in arrays])


def joined(arr: Column, sep: str = ",") -> Column:
    """S-35: the filled entries of an array in one text."""
    return F.array_join(F.filter(F.coalesce(arr, F.array().cast("array<string>")), lambda x: filled(x).isNotNull()), sep)


def topics(tags: Column) -> Column:
    """S-35: the names of the tags of type ``topic``, joined."""
    return joined(F.transform(F.filter(tags, lambda t: t["type"] == "topic"), lambda t: t["name"]))


def last_token(c: Column, sep: str = "_") -> Column:
    """S-38: what stands behind the last separator, all of it where there is none."""
    return F.element_at(F.split(c, re.escape(sep)), -1)


def counts_by_type(arr: Column) -> Column:
    """S-36: an array of (type, count) as a map; of a repeated type the last counts."""
    return last_of(F.transform(arr, lambda x: F.struct(x["type"].alias("k"), x["count"].alias("v"))))


def tag_map(tags: Column) -> Column:
    """S-36: an array of (tag_type, content) as JSON text, by type."""
    return F.to_json(last_of(F.transform(tags, lambda x: F.struct(x["tag_type"].alias("k"), x["content"].alias("v")))))


def gender(code: Column, platform: str) -> Column:
    """S-37: codes differ by platform."""
    if platform == "wb":
        return F.when(code == "f", "女").otherwise("男")
    if platform == "xhs":
        return F.when(code.cast("string") == "1", "Female").when(code.cast("string") == "0", "Male")
    return F.when(code.cast("string") == "1", "Male").when(code.cast("string") == "0", "Female").otherwise("Unknown")


def after_prefix(c: Column, prefix: str) -> Column:
    """S-38."""
    return F.replace(c, F.lit(prefix), F.lit(""))


def cookies(c: Column) -> Column:
    """S-39: ``a=b; c=d``; entries with other than one ``=`` go, of a repeated name the last holds."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: F.length(x) - F.length(F.replace(x, F.lit("="), F.lit(""))) == 1)
    return last_of(F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.split_part(x, F.lit("="), F.lit(2)).alias("v"))))


def log_level(c: Column) -> Column:
    """S-40."""
    up = F.upper(c)
    return F.when(up.rlike("ERROR|FAILED"), "error").when(up.rlike("WARNING|WARN"), "warning").when(up.rlike("SUCCESS|完成|成功"), "success").when(up.rlike("DEBUG"), "debug").otherwise("info")


def date_in(c: Column) -> Column:
    """S-41: a date of this century, zero-padded."""
    p = r"(20\d{2})\D{0,2}(\d{1,2})\D{0,2}(\d{1,2})"
    y, m, d = (F.regexp_extract(c, p, k) for k in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise("")


def title_in(c: Column) -> Column:
    return F.regexp_extract(c, "《(.+?)》", 1)


def marked(labels: list[str], marks: list[Column], mark: str = "＋") -> Column:
    """S-42: the labels whose column holds the mark."""
    return F.concat_ws("|", *[F.when(strip(m) == mark, F.lit(x)) for x, m in zip(labels, marks)])


def remarks(parts: dict[str, Column], sep: str = "; ") -> Column:
    """S-42: ``name:value`` of every value that is filled."""
    return F.concat_ws(sep, *[F.when(filled(v).isNotNull(), F.concat(F.lit(f"{k}:"), strip(v))) for k, v in parts.items()])


def expired(expires: Column, now: Column, buffer_seconds: int = 30) -> Column:
    """S-43: null never expires."""
    return F.coalesce(now >= expires - F.make_dt_interval(secs=F.lit(buffer_seconds)), F.lit(False))


def merged(a: Column, b: Column) -> Column:
    """S-44: shallow merge of maps, the second wins."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


#: S-46: lines that open a chapter or an article.
CHAPTER = r"^第[一二三四五六七八九十百零]+章"
ARTICLE = r"^(第[一二三四五六七八九十百零]+条|[一二三四五六七八九十]+、|\d+\.)"
DATE_LINE = r"^20\d{2}年\d{1,2}月\d{1,2}日$"


#: S-33: patterns of a forum page. Fixed values.
PAGE_PATTERNS = {"ip_location": r"IP属地:(\S+)</span>", "publish_time": r'<span class="tail-info">(\d{4}-\d{2}-\d{2} \d{2}:\d{2})</span>', "registration": r"<span>吧龄:(\S+)</span>"}
_COUNT = r'<span class="concern_num">\(<a[^>]*>(\d+)</a>\)</span>'


def page_facts(c: Column, male: str, female: str) -> dict[str, Column]:
    """S-33: place, time, gender by a mark in the page, counts of those followed and following, and registration age."""
    counts = F.regexp_extract_all(c, F.lit(_COUNT))
    number = lambda k: F.coalesce(F.get(counts, F.lit(k)), F.lit("0"))
    out = {name: F.regexp_extract(c, p, 1) for name, p in PAGE_PATTERNS.items()}
    return out | {"gender": F.when(c.contains(male), "Male").when(c.contains(female), "Female").otherwise("Unknown"), "follows": number(0), "fans": number(1)}


def thread_id(url: Column) -> Column:
    """S-32: the last segment of a thread's path, without its query."""
    return F.element_at(F.split(F.split_part(url, F.lit("?"), F.lit(1)), "/"), -1)


def named_author(users: Column, key: Column) -> Column:
    """JOIN-09: a name from a page's map of users, blank where it is not there."""
    return F.coalesce(F.try_element_at(users, key), F.lit(""))

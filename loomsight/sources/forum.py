"""Records of forum pages: one parse of a page into a tree of elements, fields by tables of steps, the rest in Spark.

Python only parses and looks up elements; embedded JSON, urls, counts and times are taken apart by native functions.
A step is a tag with classes or attributes; a field follows its steps down from its row's element (or from the page) to
the first element that fits, and takes its own text, all its text, an attribute or its markup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsight.functions import scalars as S

#: Elements without an end. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end where another of the same kind begins beside them. Fixed values.
SIBLINGS = frozenset("li option tr td th dt dd p".split())
#: Where the urls of the forum's records begin. Fixed value.
SITE = "https://tieba.baidu.com"


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    up: "Element | None" = None
    children: list = field(default_factory=list)

    def all(self) -> Iterator["Element"]:
        """The elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            one = stack.pop()
            yield one
            stack += [c for c in reversed(one.children) if isinstance(c, Element)]

    def own_text(self) -> str:
        """The first text right below."""
        return next((c for c in self.children if isinstance(c, str)), "").strip()

    def whole_text(self) -> str:
        out, stack = [], [self]
        while stack:
            one = stack.pop()
            if isinstance(one, str):
                out.append(one)
            else:
                stack += reversed(one.children)
        return "".join(out).strip()

    def markup(self) -> str:
        out, stack = [], [self]
        while stack:
            one = stack.pop()
            if isinstance(one, tuple):
                out.append(one[0])
            elif isinstance(one, str):
                out.append(escape(one, quote=False))
            else:
                out.append(f"<{one.tag}{''.join(f' {k}={chr(34)}{escape(v)}{chr(34)}' for k, v in one.attrs.items())}>")
                if one.tag not in VOID:
                    stack.append((f"</{one.tag}>",))
                    stack += reversed(one.children)
        return "".join(out)


class Tree(HTMLParser):
    """A page as elements; broken markup is taken as it comes: an end without a begin is nothing, an open element ends with what holds it."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.at = self.root
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in SIBLINGS and self.at.tag == tag:
            self.at = self.at.up
        one = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(one)
        if tag not in VOID:
            self.at = one

    def handle_endtag(self, tag):
        one = self.at
        while one is not None and one.tag != tag:
            one = one.up
        if one is not None and one.up is not None:
            self.at = one.up

    def handle_data(self, data):
        if data:
            self.at.children.append(data)


@dataclass(frozen=True)
class Step:
    """An element of that tag (any, if blank) with all these classes, these attributes, and an attribute that begins so."""

    tag: str = ""
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str], ...] = ()
    begins: tuple[str, str] | None = None

    def fits(self, e: Element) -> bool:
        if self.tag and e.tag != self.tag:
            return False
        if self.classes and not set(self.classes) <= set(e.attrs.get("class", "").split()):
            return False
        if any(e.attrs.get(k) != v for k, v in self.attrs):
            return False
        return self.begins is None or e.attrs.get(self.begins[0], "").startswith(self.begins[1])


def step(tag: str = "", *classes: str, begins: tuple[str, str] | None = None, **attrs: str) -> Step:
    return Step(tag, classes, tuple(attrs.items()), begins)


@dataclass(frozen=True)
class Field:
    """``take``: ``text``, ``all``, ``markup`` or the name of an attribute; ``nth`` of those that fit; ``page``: looked for in the whole page."""

    steps: tuple[Step, ...]
    take: str = "text"
    nth: int = 0
    page: bool = False


def one(*steps: Step, take: str = "text", nth: int = 0, page: bool = False) -> Field:
    return Field(steps, take, nth, page)


def _found(e: Element, steps: tuple[Step, ...]) -> Iterator[Element]:
    if not steps:
        yield e
        return
    seen: set[int] = set()
    for x in e.all():
        if steps[0].fits(x):
            for y in _found(x, steps[1:]):
                if id(y) not in seen:
                    seen.add(id(y))
                    yield y


def _taken(e: Element, f: Field) -> str:
    hit = next((x for k, x in enumerate(_found(e, f.steps)) if k == f.nth), None)
    if hit is None:
        return ""
    return {"text": hit.own_text, "all": hit.whole_text, "markup": hit.markup}[f.take]() if f.take in ("text", "all", "markup") else hit.attrs.get(f.take, "").strip()


def elements(pages: DataFrame, rows: tuple[Step, ...], fields: dict[str, Field], key: str = "page_id", column: str = "html", comments: bool = False) -> DataFrame:
    """``key, pos`` and a text column for each field, a row for each element that ``rows`` leads to; blank where nothing fits.

    With ``comments`` what stands in comments counts as markup. A null page has no rows.
    """
    kind = pages.schema[key].dataType.simpleString()
    names = list(fields)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page is None:
                    continue
                root = Tree(page.replace("<!--", "").replace("-->", "") if comments else page).root
                for pos, e in enumerate(_found(root, rows)):
                    out.append((k, pos, *[_taken(root if f.page else e, f) for f in fields.values()]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [key, "pos", *names])

    return pages.select(key, column).mapInArrow(run, f"{key} {kind}, pos long, {', '.join(f'`{n}` string' for n in names)}")


def _url(path: Column) -> Column:
    return F.concat(F.lit(SITE), path)


def _json(column: str, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


_FORUM = step("a", "card_title_fname")
_FACE, _NAME = step("a", "p_author_face"), step("a", "p_author_name", "j_user_card")
_TAIL = one(step("div", "post-tail-wrap"), take="markup")


def _tail(column: str) -> dict[str, Column]:
    return {"ip_location": F.regexp_extract(column, S.PAGE_PATTERNS["ip_location"], 1), "publish_time": F.regexp_extract(column, S.PAGE_PATTERNS["publish_time"], 1)}


def search_notes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """S-32: the posts of a search page."""
    title, home, forum = (step("span", "p_title"), step("a")), step("a", begins=("href", "/home/main")), step("a", "p_forum")
    fields = {
        "note_id": one(*title, take="data-tid"), "title": one(*title), "desc": one(step("div", "p_content")), "path": one(*title, take="href"), "user_nickname": one(home, step("font")),
        "user_path": one(home, take="href"), "tieba_name": one(forum, step("font")), "tieba_path": one(forum, take="href"), "publish_time": one(step("font", "p_green", "p_date")),
    }
    out = elements(pages, (step("div", "s_post"),), fields, key)
    return out.select(key, "pos", "note_id", "title", "desc", _url(F.col("path")).alias("note_url"), "user_nickname", _url(F.col("user_path")).alias("user_link"), "tieba_name", _url(F.col("tieba_path")).alias("tieba_link"), "publish_time")


def thread_notes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """S-32: the threads of a forum's page, whose list stands in a comment; those without embedded JSON go."""
    fields = {
        "j": Field((), "data-field"), "title": one(step("a", "j_th_tit")), "desc": one(step("div", "threadlist_abs", "threadlist_abs_onlyline")), "user_path": one(step("a", "frs-author-name", "j_user_card"), take="href"),
        "tieba_name": one(_FORUM, page=True), "tieba_path": one(_FORUM, take="href", page=True),
    }
    out = elements(pages, (step("ul", id="thread_list"), step("li")), fields, key, comments=True)
    note = _json("j", "id")
    out = out.where(note.isNotNull())
    return out.select(
        key, "pos", note.alias("note_id"), "title", "desc", F.concat(F.lit(f"{SITE}/p/"), note).alias("note_url"), _url(F.col("user_path")).alias("user_link"),
        F.coalesce(F.nullif(_json("j", "authoer_nickname"), F.lit("")), _json("j", "author_name")).alias("user_nickname"), "tieba_name", _url(F.col("tieba_path")).alias("tieba_link"), F.coalesce(_json("j", "reply_num").try_cast("int"), F.lit(0)).alias("total_replay_num"),
    )


def note_details(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """S-32: the post that a page shows, one row a page: from its title, its first floor and its counts."""
    post, counts = step("div", "p_postlist"), (step("div", id="thread_theme_5"), step("li", "l_reply_num"), step("span", "red"))
    fields = {
        "only": one(step(id="lzonly_cntn"), take="href"), "head": one(step("title")), "desc": one(step("meta", name="description"), take="content"), "user_path": one(post, _FACE, take="href"), "user_nickname": one(post, _NAME),
        "user_avatar": one(post, _FACE, step("img"), take="src"), "tieba_name": one(_FORUM), "tieba_path": one(_FORUM, take="href"), "tail": _TAIL, "total_replay_num": one(*counts), "total_replay_page": one(*counts, nth=1),
    }
    out = elements(pages, (), fields, key)
    note = S.thread_id(F.col("only"))
    title = F.replace("head", F.concat(F.lit("【"), F.col("tieba_name"), F.lit("】_Baidu Tieba")), F.lit(""))
    return out.select(key, note.alias("note_id"), title.alias("title"), "desc", F.concat(F.lit(f"{SITE}/p/"), note).alias("note_url"), _url(F.col("user_path")).alias("user_link"), "user_nickname", "user_avatar", "tieba_name", _url(F.col("tieba_path")).alias("tieba_link"), *[c.alias(n) for n, c in _tail("tail").items()], "total_replay_num", "total_replay_page")


def comments(pages: DataFrame, key: str = "page_id", note: str = "note_id") -> DataFrame:
    """S-32: first-level comments of the page of ``note``; those without embedded JSON go."""
    fields = {"j": Field((), "data-field"), "user_path": one(_FACE, take="href"), "user_nickname": one(_NAME), "user_avatar": one(_FACE, step("img"), take="src"), "tieba_name": one(_FORUM, page=True), "tail": _TAIL}
    out = elements(pages, (step("div", "l_post", "l_post_bright", "j_l_post", "clearfix"),), fields, key)
    out = out.where(_json("j", "content").isNotNull()).join(pages.select(key, note), key)
    return out.select(
        key, "pos", _json("j", "content.post_id").alias("comment_id"), _json("j", "content.comment_num").try_cast("int").alias("sub_comment_count"), S.html_text(_json("j", "content.content")).alias("content"), note, F.concat(F.lit(f"{SITE}/p/"), note).alias("note_url"),
        _url(F.col("user_path")).alias("user_link"), "user_nickname", "user_avatar", F.coalesce(_json("j", "content.forum_id"), F.lit("")).alias("tieba_id"), "tieba_name", F.concat(F.lit(f"{SITE}/f?kw="), "tieba_name").alias("tieba_link"), *[c.alias(n) for n, c in _tail("tail").items()],
    )


def sub_comments(pages: DataFrame, parents: DataFrame, key: str = "page_id") -> DataFrame:
    """S-32: second-level comments of a page; ``parents`` has the comment the page belongs to, by ``key``, and its note and forum."""
    user = step("a", "j_user_card", "lzl_p_p")
    fields = {"j": Field((), "data-field"), "content": one(step("span", "lzl_content_main"), take="markup"), "user_link": one(user, take="href"), "user_avatar": one(user, step("img"), take="src"), "publish_time": one(step("span", "lzl_time"))}
    out = elements(pages, (step("li", "lzl_single_post", "j_lzl_s_p"),), fields, key).where(_json("j", "spid").isNotNull())
    of = parents.select(key, F.col("comment_id").alias("parent_comment_id"), "note_id", "note_url", "tieba_id", "tieba_name", "tieba_link")
    return out.join(of, key).select(key, "pos", _json("j", "spid").alias("comment_id"), S.html_text(F.col("content")).alias("content"), "user_link", _json("j", "showname").alias("user_nickname"), "user_avatar", "publish_time", *[c for c in of.columns if c != key])


def creators(pages: DataFrame, male: str, female: str, key: str = "page_id") -> DataFrame:
    """S-32: the person whose home a page is, one row a page. ``male`` and ``female`` are marks in its markup."""
    fields = {
        "link": one(step("p", "space"), step("a"), take="href"), "nickname": one(step("span", "userinfo_username")), "avatar": one(step("div", "userinfo_left_head"), step("img"), take="src"), "data": one(step("div", "userinfo_userdata"), take="markup"),
        "first": one(step("span", "concern_num"), take="markup"), "second": one(step("span", "concern_num"), take="markup", nth=1), "third": one(step("span", "concern_num"), take="markup", nth=2),
    }
    out = elements(pages, (), fields, key)
    params = S.url_params(F.try_url_decode("link"))
    both = (F.col("second") != "") & (F.col("third") == "")
    count = lambda c: F.when(both, F.regexp_extract(c, r"\(<a[^>]*>(\d+)</a>\)", 1).try_cast("int"))
    gender = F.when(F.col("data").contains(male), "Male").when(F.col("data").contains(female), "Female").otherwise("Unknown")
    named = lambda n: F.coalesce(F.try_element_at(params, F.lit(n)), F.lit(""))
    return out.select(
        key, named("id").alias("user_id"), named("un").alias("user_name"), "nickname", "avatar", gender.alias("gender"), F.regexp_extract("data", S.PAGE_PATTERNS["ip_location"], 1).alias("ip_location"),
        F.coalesce(count("first"), F.lit(0)).alias("follows"), F.coalesce(count("second"), F.lit(0)).alias("fans"), F.regexp_extract("data", S.PAGE_PATTERNS["registration"], 1).alias("registration_duration"),
    )


def thread_ids(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """S-32: ids of a person's threads, from their home."""
    out = elements(pages, (step("ul", "new_list", "clearfix"), step("div", "thread_name")), {"href": one(step("a"), take="href")}, key)
    return out.where("href <> ''").select(key, "pos", S.thread_id(F.col("href")).alias("thread_id"))

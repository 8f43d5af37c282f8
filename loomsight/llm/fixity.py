"""Merkle fixity audit of WARC replicas.

Pages are laid out as WARC records in archive files, a file for each ``FILE_IDS`` page ids, in order of id. The lowest nodes
hold the records of one page id, more than one if an id repeats; each ``FANOUT`` neighbours, taken with the offset range
that each fills within it, hash to a node, up through the file and on over the files to one root. Two replicas are
compared at the root, and only below nodes that differ is the next level read, down to the records: work follows the
damage, not the archive.

Nodes stand by page id and ranges count from the start of their node, so a record lost or added in mid-file moves the bytes
of those behind it but changes none of their nodes: it is one finding. Records of an id that differ are paired with those
of the same id and url in the other replica; what finds no partner is ``missing`` or ``extra``.

An id that repeats is dealt over parts by the digests of url and record, up to 4096 by each, and equal records are counted
once, so neither null ids nor a repeated record are one task's; ranges there follow that order. Only those that differ and
share id and url are paired in one window.

Defined results: null url or html is empty; pages with a null id stand before all others in file -1; repeated ids follow
url, then html order, repeated rows are records of their own; of equal records some of which are lost, the last are
reported; a record whose url changed is ``missing`` and ``extra``; columns beyond ``page_id, url, html`` are not read;
empty replicas are equal and give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsight.llm.common import pick, staged, table

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
FILE_IDS = 1000


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's resource record."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame) -> DataFrame:
    """``file, place, page_id, by_url, start, length, digest`` of a replica's records. Only digests are sorted, never pages.

    Places and offsets are sums from chunk to chunk: records of an id by the start of their url's digest, in those the
    records of a url by the start of their own, in those the records. No window sees all records of an id that repeats.
    """
    own = pick(pages, "page_id", "url", "html")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    lean = own.select(
        F.coalesce(F.floor(F.col("page_id") / FILE_IDS), F.lit(-1)).cast("long").alias("file"),
        F.col("page_id").cast("long").alias("page_id"),
        F.sha2(F.coalesce("url", F.lit("")), 256).alias("by_url"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("digest"),
    )
    kinds = lean.groupBy("file", "page_id", "by_url", "digest", "length").agg(F.count("*").alias("copies"))
    id = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    kinds = staged(kinds, "record-kinds").withColumns({"id": id, "u": F.substring("by_url", 1, 3), "d": F.substring("digest", 1, 3)})
    kinds = kinds.withColumn("size", F.col("copies") * F.col("length"))
    wide, narrow = ["file", "page_id", "id", "u"], ["file", "page_id", "id", "u", "by_url", "d"]
    in_url = kinds.groupBy(*narrow).agg(F.sum("copies").alias("copies"), F.sum("size").alias("size"))
    in_id = in_url.groupBy(*wide).agg(F.sum("copies").alias("copies"), F.sum("size").alias("size"))

    def behind(chunks, within, order, before):
        """``chunks`` with the records ``n`` and bytes ``at`` in front of each, those in front of all of them added."""
        earlier = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        ahead = {n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in (("n", "copies"), ("at", "size"))}
        if before is None:
            return chunks.withColumns(ahead)
        told = before.select(*within, F.col("n").alias("n0"), F.col("at").alias("at0"))
        out = chunks.withColumns(ahead).join(told, within)
        return out.withColumns({"n": F.col("n") + F.col("n0"), "at": F.col("at") + F.col("at0")}).drop("n0", "at0")

    key = lambda names: [c for c in names if c != "page_id"]
    by_id = behind(in_id, ["file"], ["page_id", "u"], None)
    by_url = behind(in_url, key(wide), ["by_url", "d"], by_id)
    one = behind(kinds, key(narrow), ["digest"], by_url).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return one.select(
        "file",
        (F.col("n") + F.col("copy")).cast("long").alias("place"),
        "page_id",
        "by_url",
        (F.col("at") + F.col("copy") * F.col("length")).cast("long").alias("start"),
        "length",
        "digest",
    )


#: Bits of a page id within its file: 0 is a null id, 1 to ``FILE_IDS`` the others.
ID_BITS = 12
_KIND = ["file", "page_id", "by_url", "digest", "length"]


def _bits(digest: str, n: int) -> Column:
    """The first ``n`` bits of a hexadecimal digest, ``n`` a multiple of four."""
    return F.conv(F.substring(digest, 1, n // 4), 16, 10).cast("long") if n else F.lit(0).cast("long")


def _kinds(both: DataFrame, bits: int) -> DataFrame:
    """Different records of each side with their copies and first place, under the node ``i`` that holds them."""
    slot = F.coalesce(F.pmod("page_id", F.lit(FILE_IDS)) + 1, F.lit(0))
    own = F.shiftleft(_bits("by_url", bits), bits).bitwiseOR(_bits("digest", bits))
    i = F.shiftleft(F.shiftleft("file", ID_BITS).bitwiseOR(slot), 2 * bits).bitwiseOR(own)
    return both.groupBy("side", *_KIND).agg(F.count("*").alias("copies"), F.min("place").alias("place"), F.min("start").alias("start")).withColumn("i", i)


def _leaves(kinds: DataFrame) -> DataFrame:
    """The lowest nodes: their records in order, with copies and the bytes that each takes."""
    held = F.sort_array(F.collect_list(F.struct("by_url", "digest", "copies", "length")))
    text = F.array_join(F.transform(held, lambda r: F.concat_ws("=", r["digest"], r["copies"].cast("string"), r["length"].cast("string"))), ":")
    return kinds.groupBy("side", "i").agg(F.sha2(text, 256).alias("digest"), F.sum(F.col("copies") * F.col("length")).alias("size"))


def _above(nodes: DataFrame) -> DataFrame:
    """The parents of nodes: at most ``FANOUT`` children each, whose digests and ranges within the parent they hash."""
    kids = F.sort_array(F.collect_list(F.struct("i", "digest", "size")))
    ranges = F.aggregate(
        kids,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")),
        lambda s, k: F.struct(
            (s["at"] + k["size"]).alias("at"),
            F.concat(s["text"], F.concat_ws("=", k["i"].cast("string"), s["at"].cast("string"), (s["at"] + k["size"]).cast("string"), k["digest"]), F.lit(":")).alias("text"),
        ),
        lambda s: s["text"],
    )
    return nodes.groupBy("side", F.shiftright("i", FANOUT_BITS).alias("i")).agg(F.sha2(ranges, 256).alias("digest"), F.sum("size").alias("size"))


def _of(side: int, c: str) -> Column:
    return F.max(F.when(F.col("side") == side, F.col(c)))


def _differing(nodes: DataFrame) -> DataFrame:
    pair = nodes.groupBy("i").agg(_of(0, "digest").alias("expected"), _of(1, "digest").alias("found"))
    return pair.filter(~F.col("expected").eqNullSafe(F.col("found"))).select("i")


def _findings(kinds: DataFrame) -> DataFrame:
    """The records that one side has more of than the other, paired by id and url."""
    told = [_of(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("copies", "place", "start")]
    both = kinds.groupBy(*_KIND).agg(*told).withColumns({f"copies{k}": F.coalesce(f"copies{k}", F.lit(0)) for k in (0, 1)})
    side = F.when(F.col("copies0") > F.col("copies1"), 0).otherwise(1)
    copy = F.explode(F.sequence(F.least("copies0", "copies1"), F.greatest("copies0", "copies1") - 1))
    more = both.filter("copies0 <> copies1").withColumn("side", side).withColumn("copy", copy)
    first = lambda c: F.when(F.col("side") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    more = more.withColumns({"place": first("place") + F.col("copy"), "start": first("start") + F.col("copy") * F.col("length")})
    more = more.withColumn("k", F.row_number().over(Window.partitionBy("side", "file", "page_id", "by_url").orderBy("place")))
    more = more.withColumn("r", F.struct("place", "start", "length", "digest"))
    pair = more.groupBy("file", "page_id", "by_url", "k").agg(_of(0, "r").alias("a"), _of(1, "r").alias("b"))
    at = F.coalesce("a", "b")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered")
    return pair.select("file", at["place"].alias("place"), "page_id", at["start"].alias("start"), at["length"].alias("length"), F.col("a.digest").alias("expected"), F.col("b.digest").alias("found"), state.alias("state"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which two tables of ``records`` differ: ``file, place, page_id, start, length, expected, found, state``."""
    both = staged(primary.withColumn("side", F.lit(0)).unionByName(replica.withColumn("side", F.lit(1))), "replicas")
    ends = both.groupBy("side", "file", "page_id").agg(F.count_distinct("by_url", "digest").alias("n")).agg(F.max("n"), F.max("file"), F.min("file")).first()
    over = lambda n: -(-n // FANOUT_BITS) * FANOUT_BITS
    bits = 0 if ends[0] is None else min(12, over((int(ends[0]) - 1).bit_length()))
    files = 0 if ends[1] is None else max(int(ends[1]).bit_length(), (-int(ends[2])).bit_length() if ends[2] < 0 else 0)
    height = (ID_BITS + 2 * bits + over(files)) // FANOUT_BITS
    kinds = staged(_kinds(both, bits), "kinds")
    levels = [staged(_leaves(kinds), "leaves")]
    for k in range(height):
        levels.append(staged(_above(levels[-1]), f"level-{k + 1}"))
    bad = staged(_differing(levels[-1]), "differing-roots")
    for k in range(height - 1, -1, -1):
        below = levels[k].withColumn("parent", F.shiftright("i", FANOUT_BITS)).join(bad.withColumnRenamed("i", "parent"), "parent", "left_semi")
        bad = staged(_differing(below), f"differing-{k}")
    return _findings(kinds.join(bad, "i", "left_semi"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica as a failing disk leaves it: in every 101st page, by id, the first character is overwritten."""
    hit = (F.pmod(F.col("page_id"), F.lit(101)) == 7) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("~"), F.substr("html", F.lit(2)))).otherwise(F.col("html")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all pages against a damaged replica of them."""
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return audit(records(pages), records(damaged(pages)))


SQL = r"""
with p as (
  select page_id::bigint as page_id, coalesce(url, '') as url, coalesce(html, '') as html,
    coalesce(floor(page_id / 1000.0), -1)::bigint as file,
    case when (page_id % 101 + 101) % 101 = 7 and length(html) > 0 then '~' || substring(html, 2) else coalesce(html, '') end as bad
  from pages),
w as (
  select *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' as head,
    chr(13) || chr(10) || chr(13) || chr(10) as gap
  from p),
r as (
  select *, head || strlen(html)::varchar || gap || html || gap as good_record, head || strlen(bad)::varchar || gap || bad || gap as bad_record from w),
o as (
  select *, row_number() over (partition by file order by page_id, sha256(url), sha256(good_record)) - 1 as place,
    sum(strlen(good_record)) over (partition by file order by page_id, sha256(url), sha256(good_record) rows unbounded preceding) - strlen(good_record) as start
  from r)
select file, place::bigint as place, page_id, start::bigint as start, strlen(good_record)::bigint as length, sha256(good_record) as expected, sha256(bad_record) as found, 'altered' as state
from o where good_record <> bad_record
"""

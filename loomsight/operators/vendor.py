"""Crawled records: flattening nested JSON by mapping tables, cards, day ranges, catalog of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsight.functions import scalars as S

#: PRJ-03, PRJ-04: column to JSON paths, first filled one wins, by platform.
CONTENT = {
    "xhs": {"note_id": ["note_id"], "type": ["type"], "title": ["title", "desc"], "desc": ["desc"], "time": ["time"], "user_id": ["user.user_id"], "nickname": ["user.nickname", "user.nick_name"], "liked_count": ["interact_info.liked_count"], "collected_count": ["interact_info.collected_count"], "comment_count": ["interact_info.comment_count"], "share_count": ["interact_info.share_count"], "ip_location": ["ip_location"]},
    "bili": {"video_id": ["View.aid"], "title": ["View.title"], "desc": ["View.desc"], "create_time": ["View.pubdate"], "user_id": ["View.owner.mid"], "nickname": ["View.owner.name"], "liked_count": ["View.stat.like"], "video_play_count": ["View.stat.view"], "video_favorite_count": ["View.stat.favorite"], "video_share_count": ["View.stat.share"], "video_comment": ["View.stat.reply"]},
    "dy": {"aweme_id": ["aweme_id"], "aweme_type": ["aweme_type"], "title": ["desc"], "desc": ["desc"], "create_time": ["create_time"], "user_id": ["author.uid"], "nickname": ["author.nickname"], "liked_count": ["statistics.digg_count"], "collected_count": ["statistics.collect_count"], "comment_count": ["statistics.comment_count"], "share_count": ["statistics.share_count"], "ip_location": ["ip_label"]},
    "wb": {"note_id": ["mblog.id"], "content": ["mblog.text"], "created_at": ["mblog.created_at"], "user_id": ["mblog.user.id"], "nickname": ["mblog.user.screen_name"], "liked_count": ["mblog.attitudes_count"], "comments_count": ["mblog.comments_count"], "shared_count": ["mblog.reposts_count"], "ip_location": ["mblog.region_name"]},
    "ks": {"video_id": ["photo.id"], "video_type": ["type"], "title": ["photo.caption"], "create_time": ["photo.timestamp"], "user_id": ["author.id"], "nickname": ["author.name"], "liked_count": ["photo.realLikeCount"], "viewd_count": ["photo.viewCount"]},
    "tieba": {"note_id": ["note_id"], "title": ["title"], "desc": ["desc"], "publish_time": ["publish_time"], "user_nickname": ["user_nickname"], "total_replay_num": ["total_replay_num"]},
    "zhihu": {"content_id": ["id"], "content_type": ["type"], "title": ["title", "question.title"], "desc": ["excerpt", "description"], "created_time": ["created_time", "created"], "updated_time": ["updated_time", "updated"], "voteup_count": ["voteup_count"], "comment_count": ["comment_count"]},
}
COMMENT = {
    "ks": {"comment_id": ["comment_id", "commentId"], "content": ["content"], "user_id": ["author_id", "authorId"], "nickname": ["author_name", "authorName"], "create_time": ["timestamp"], "avatar": ["headurl"], "sub_comment_count": ["commentCount", "subCommentCount"]},
    "xhs": {"comment_id": ["id"], "create_time": ["create_time"], "ip_location": ["ip_location"], "content": ["content"], "user_id": ["user_info.user_id"], "nickname": ["user_info.nickname"], "avatar": ["user_info.image"], "sub_comment_count": ["sub_comment_count"], "pictures": ["pictures[*].url_default"], "parent_comment_id": ["target_comment.id"], "like_count": ["like_count"]},
    "bili": {"comment_id": ["rpid"], "parent_comment_id": ["parent"], "create_time": ["ctime"], "content": ["content.message"], "user_id": ["member.mid"], "nickname": ["member.uname"], "sex": ["member.sex"], "sign": ["member.sign"], "avatar": ["member.avatar"], "sub_comment_count": ["rcount"], "like_count": ["like"]},
    "dy": {"comment_id": ["cid"], "create_time": ["create_time"], "ip_location": ["ip_label"], "aweme_id": ["aweme_id"], "content": ["text"], "user_id": ["user.uid"], "sec_uid": ["user.sec_uid"], "short_user_id": ["user.short_id"], "user_unique_id": ["user.unique_id"], "user_signature": ["user.signature"], "nickname": ["user.nickname"], "sub_comment_count": ["reply_comment_total"], "like_count": ["digg_count"], "parent_comment_id": ["reply_id"]},
    "wb": {"comment_id": ["id"], "create_time": ["created_at"], "content": ["text"], "sub_comment_count": ["total_number"], "comment_like_count": ["like_count"], "ip_location": ["source"], "parent_comment_id": ["rootid"], "user_id": ["user.id"], "nickname": ["user.screen_name"], "gender": ["user.gender"], "profile_url": ["user.profile_url"], "avatar": ["user.profile_image_url"]},
    "zhihu": {"comment_id": ["id"], "parent_comment_id": ["reply_comment_id"], "content": ["content"], "publish_time": ["created_time"], "sub_comment_count": ["child_comment_count"], "like_count": ["like_count"], "dislike_count": ["dislike_count"], "user_id": ["author.id"], "user_nickname": ["author.name"]},
}
#: PRJ-03: the same for people.
CREATOR = {
    "xhs": {"nickname": ["basicInfo.nickname"], "gender": ["basicInfo.gender"], "avatar": ["basicInfo.images"], "desc": ["basicInfo.desc"], "ip_location": ["basicInfo.ipLocation"]},
    "bili": {"user_id": ["Card.card.mid"], "nickname": ["Card.card.name"], "sex": ["Card.card.sex"], "sign": ["Card.card.sign"], "avatar": ["Card.card.face"], "total_fans": ["Card.card.fans"], "total_liked": ["Card.like_num"], "user_rank": ["Card.card.level_info.current_level"], "is_official": ["Card.card.official_verify.type"]},
    "dy": {"nickname": ["user.nickname"], "gender": ["user.gender"], "avatar": ["user.avatar_300x300.uri"], "desc": ["user.signature"], "ip_location": ["user.ip_location"], "follows": ["user.following_count"], "fans": ["user.max_follower_count"], "interaction": ["user.total_favorited"], "videos_count": ["user.aweme_count"]},
    "wb": {"nickname": ["screen_name"], "gender": ["gender"], "avatar": ["avatar_hd"], "desc": ["description"], "ip_location": ["source"], "follows": ["follow_count"], "fans": ["followers_count"]},
    "ks": {"nickname": ["profile.user_name"], "gender": ["profile.gender"], "avatar": ["profile.headurl"], "desc": ["profile.user_text"], "follows": ["ownerCount.follow"], "fans": ["ownerCount.fan"], "interaction": ["ownerCount.photo_public"]},
    "zhihu": {"user_id": ["id"], "nickname": ["name"], "gender": ["gender"], "ip_location": ["ip_info"], "follows": ["following_count"], "fans": ["follower_count"], "answer_count": ["answer_count"], "video_count": ["zvideo_count"], "article_count": ["articles_count"]},
}
#: PRJ-03: relations and posts of a person, by the person's and the other's JSON. Fixed names.
CONTACT = {"up_id": "id", "up_name": "name", "up_sign": "sign", "up_avatar": "avatar"}


def comment_rows(df: DataFrame, platform: str, column: str = "raw", asked: str | None = None) -> DataFrame:
    """PRJ-03: comments of a platform, counts 0 where they are missing. ``asked`` holds the id whose comments were asked for:
    comments of another one go, where a comment names it."""
    out = flatten(df, column, COMMENT[platform])
    numbers = [c for c in COMMENT[platform] if c.endswith("_count")]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit("0")) for c in numbers})
    if "parent_comment_id" in out.columns:
        out = out.withColumn("parent_comment_id", F.coalesce("parent_comment_id", F.lit("0")))
    if platform == "xhs":
        # one picture stands alone, several as JSON
        out = out.withColumn("pictures", F.array_join(F.coalesce(F.from_json("pictures", "array<string>"), F.array(F.trim(F.coalesce("pictures", F.lit("")), F.lit('"')))), ","))
    if platform == "wb":
        _, wall = S.rfc2822(F.col("create_time"))
        out = out.withColumns({"content": S.inline_text(F.col("content")), "create_time": wall, "ip_location": S.after_prefix(F.coalesce("ip_location", F.lit("")), "来自")})
    if platform == "dy" and asked:
        out = own_comments(out, "aweme_id", asked)
    return out


def creator_rows(df: DataFrame, platform: str, column: str = "raw") -> DataFrame:
    """PRJ-03: people of a platform; genders by the platform's codes, counts 0 where they are missing."""
    counts = {}
    if platform == "xhs":
        inter = F.from_json(F.get_json_object(column, "$.interactions"), "array<struct<type:string,count:string>>")
        by = S.counts_by_type(F.coalesce(inter, F.array().cast("array<struct<type:string,count:string>>")))
        counts = {c: F.coalesce(F.try_element_at(by, F.lit(c)), F.lit("0")) for c in ("follows", "fans", "interaction")}
    out = flatten(df.withColumns(counts) if counts else df, column, CREATOR[platform])
    if "gender" in out.columns:
        code = F.col("gender")
        by_code = {"dy": F.when(code == "1", "Male").when(code == "2", "Female").otherwise("Unknown"), "wb": F.when(code == "f", "Female").otherwise("Male"), "ks": F.when(code == "F", "Female").otherwise("Male")}
        out = out.withColumn("gender", by_code.get(platform, S.gender(code, platform)))
    if platform == "wb":
        out = out.withColumn("ip_location", S.after_prefix(F.coalesce("ip_location", F.lit("")), "来自"))
    if platform == "dy":
        out = out.withColumn("avatar", F.concat(F.lit("https://p3-pc.douyinpic.com/img/"), F.coalesce("avatar", F.lit("None")), F.lit("~c5_300x300.jpeg?from=2956013662")))
    numbers = [c for c in CREATOR[platform] if c.endswith("_count") or c in ("follows", "fans", "interaction")]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("0")) for c in numbers})


def contacts(people: DataFrame, up: str, fan: str) -> DataFrame:
    """PRJ-03: who follows whom, from two JSON columns."""
    side = lambda column, name: [F.get_json_object(column, f"$.{path}").alias(c.replace("up_", f"{name}_")) for c, path in CONTACT.items()]
    return people.select(*side(up, "up"), *side(fan, "fan"))


def flatten(df: DataFrame, column: str, mapping: dict[str, list[str]]) -> DataFrame:
    """PRJ-03, PRJ-04: JSON text to text columns; an empty value or 0 lets the next path speak, as falsy values do."""
    value = lambda p: (lambda v: F.when(~v.isin("", "0", "false"), v))(F.get_json_object(column, f"$.{p}"))
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce(*[value(p) for p in paths], F.get_json_object(column, f"$.{paths[-1]}")).alias(name) for name, paths in mapping.items()])


def weibo_content(df: DataFrame) -> DataFrame:
    """S-24, S-26, S-38, G7: plain text, both times, region without its prefix."""
    right, wall = S.rfc2822(F.col("created_at"))
    return df.withColumns({"content": S.inline_text(F.col("content")), "create_time": wall, "create_time_utc": right, "ip_location": S.after_prefix(F.coalesce("ip_location", F.lit("")), "发布于 ")})


def cards(df: DataFrame, column: str) -> DataFrame:
    """FLT-13: cards of type 9 at the top and within groups, in order. ``column``: array of (card_type, id, card_group)."""
    own = lambda c: F.filter(F.array(F.struct(c["card_type"].alias("card_type"), c["id"].alias("id"))), lambda x: x["card_type"] == 9)
    inner = lambda c: F.filter(F.coalesce(c["card_group"], F.array().cast("array<struct<card_type:int,id:string>>")), lambda x: x["card_type"] == 9)
    return df.withColumn(column, F.flatten(F.transform(column, lambda c: F.concat(own(c), inner(c)))))


def by_kind(df: DataFrame, column: str = "type", kinds: tuple[str, ...] = ("answer", "article", "zvideo")) -> DataFrame:
    """FLT-14."""
    return df.where(F.col(column).isin(*kinds))


def own_comments(comments: DataFrame, parent: str, asked: str) -> DataFrame:
    """FLT-12."""
    return comments.where(F.col(parent) == F.col(asked))


def inherit(children: DataFrame, parents: DataFrame, columns: list[str]) -> DataFrame:
    """JOIN-08: sub-comments take attributes of their parents."""
    own = [c for c in children.columns if c not in columns]
    return children.select(*own).join(parents.select(F.col("comment_id").alias("parent_comment_id"), *columns), "parent_comment_id", "left")


def day_range(start: str, end: str, spark) -> DataFrame:
    """SRC-21: the days from ``start`` to ``end`` with their first and last second; an error if they run backwards."""
    if start > end:
        raise ValueError("start is after end")
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}')")).alias("day"))
    seconds = F.unix_timestamp(F.col("day").cast("timestamp"))
    return days.select("day", seconds.alias("first_second"), (seconds + 86399).alias("last_second"))


def capped_by_day(rows: DataFrame, key: str, day: str, order: list, daily: int, total: int) -> DataFrame:
    """SRC-20, WIN-05: at most ``daily`` rows of a key and day and ``total`` of a key, days in order.

    The daily cap leaves few rows, so the running total runs over those alone.
    """
    w = Window.partitionBy(key, day).orderBy(*order)
    kept = rows.withColumn("day_rank", F.row_number().over(w)).where(F.col("day_rank") <= daily)
    run = Window.partitionBy(key).orderBy(day, "day_rank")
    return kept.withColumn("total_rank", F.row_number().over(run)).where(F.col("total_rank") <= total)


#: AGG-18: platform of a path, the first that is named in it.
PLATFORMS = ("xhs", "dy", "ks", "bili", "wb", "tieba", "zhihu")


def path_platform(path):
    out = None
    for p in PLATFORMS:
        out = F.when(F.lower(path).contains(p), p) if out is None else out.when(F.lower(path).contains(p), p)
    return out.otherwise("other")


def catalog(files: DataFrame, platform: str | None = None, kind: str | None = None) -> DataFrame:
    """FLT-15, TOP-12. ``files``: path, length, modified."""
    df = files.withColumn("file_type", F.lower(F.element_at(F.split("path", r"\."), -1))).where(F.col("file_type").isin("json", "jsonl", "csv", "xlsx", "xls", "parquet"))
    df = df.where(F.lower("path").contains(platform.lower())) if platform else df
    return (df.where(F.col("file_type") == kind.lower()) if kind else df).orderBy(F.desc("modified"), "path")


def catalog_stats(files: DataFrame) -> DataFrame:
    """AGG-18."""
    return files.groupBy(path_platform(F.col("path")).alias("platform"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("file_type")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

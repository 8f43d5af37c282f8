"""Forum pages authored here, broken in the ways such pages are."""

import json
from html import escape

import pytest

from loomsight.sources import forum


def pages(spark, *html):
    return spark.createDataFrame([(k, h, f"n{k}") for k, h in enumerate(html)], "page_id long, html string, note_id string")


def field(**x):
    return escape(json.dumps(x, ensure_ascii=False))


FORUM = '<a class="card_title_fname" href="/f?kw=skin"> skin&amp;care </a>'
TAIL = '<div class="post-tail-wrap"><span>IP属地:广东</span><span class="tail-info">3楼</span><span class="tail-info">2026-03-01 10:20</span></div>'


def test_search(spark):
    html = """<div class="s_post"><span class="p_title"><a data-tid="77" href="/p/77?x=1"> A <b>bold</b> title</a></span><div class="p_content">body &lt;here&gt;<br>more</div>
    <a class="p_forum" href="/f?kw=skin"><font>skin</font></a><a href="/home/main?un=u"><font>someone</font></a><font class="p_green p_date">2026-03-01</font></div>
    <div class="s_post other"><span class="p_title"><a href="/p/78">second</span></div><div class="s_posts">no</div>"""
    rows = forum.search_notes(pages(spark, html, None, "")).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in rows] == [
        ("77", "A", "body <here>", "https://tieba.baidu.com/p/77?x=1", "someone", "https://tieba.baidu.com/home/main?un=u", "skin", "https://tieba.baidu.com/f?kw=skin", "2026-03-01"),
        ("", "second", "", "https://tieba.baidu.com/p/78", "", "https://tieba.baidu.com", "", "https://tieba.baidu.com", ""),
    ]


def test_threads_in_a_comment(spark):
    item = lambda f, t: f'<li class="j_thread_list" data-field="{f}"><a class="j_th_tit " href="/p/1">{t}</a><div class="threadlist_abs threadlist_abs_onlyline ">abs</div><a class="frs-author-name j_user_card " href="/home/a">x</a>'
    html = f"{FORUM}<code><!--<ul id='thread_list'>{item(field(id=5, author_name='a', reply_num=9), 'T5')}{item(field(id=6, authoer_nickname='nick', author_name='a'), 'T6')}</li><li>ad</li><li data-field='broken'>x</li></ul>--></code>"
    rows = forum.thread_notes(pages(spark, html)).orderBy("pos").collect()
    assert [(r.note_id, r.title, r.desc, r.user_nickname, r.total_replay_num, r.tieba_name, r.note_url) for r in rows] == [
        ("5", "T5", "abs", "a", 9, "skin&care", "https://tieba.baidu.com/p/5"),
        ("6", "T6", "abs", "nick", 0, "skin&care", "https://tieba.baidu.com/p/6"),
    ]


def test_detail(spark):
    html = f"""<html><head><title>Hello【skin&care】_Baidu Tieba</title><meta name="description" content="the text"></head>{FORUM}<a id="lzonly_cntn" href="/p/991?see_lz=1">only</a>
    <div id="thread_theme_5"><ul><li class="l_reply_num"><span class="red">12</span>replies<span class="red">3</span></li></ul></div>
    <div class="p_postlist"><a class="p_author_face " href="/home/z"><img src="//z.png"></a><a class="p_author_name j_user_card">zed</a>{TAIL}</div>
    <div class="p_postlist"><a class="p_author_name j_user_card">other</a></div></html>"""
    r = forum.note_details(pages(spark, html)).first()
    assert (r.note_id, r.title, r.desc, r.user_nickname, r.user_avatar, r.ip_location, r.publish_time, r.total_replay_num, r.total_replay_page) == ("991", "Hello", "the text", "zed", "//z.png", "广东", "2026-03-01 10:20", "12", "3")


def test_comments_and_sub_comments(spark):
    post = lambda f: f'<div class="l_post l_post_bright j_l_post clearfix  " data-field="{f}"><a class="p_author_face " href="/home/c"><img src="c.png"></a><a class="p_author_name j_user_card">cee</a>{TAIL}</div>'
    html = FORUM + post(field(content={"post_id": 31, "comment_num": 2, "content": "so <b>good</b><script>x</script>", "forum_id": 8})) + post(field(user=1)) + "<div class='l_post'>no</div>"
    of = pages(spark, html)
    rows = forum.comments(of).collect()
    assert [(r.comment_id, r.sub_comment_count, r.content, r.note_id, r.user_nickname, r.tieba_id, r.ip_location) for r in rows] == [("31", 2, "so good", "n0", "cee", "8", "广东")]
    sub = lambda first, f, t: f"""<li class="lzl_single_post j_lzl_s_p {first}" data-field="{f}"><a class="j_user_card lzl_p_p" href="/home/s"><img src="s.png"></a><span class="lzl_content_main">{t}</span><span class="lzl_time"> 2026-03-02 </span></li>"""
    below = pages(spark, "<ul>" + sub("first_no_border", field(spid=1, showname="s1"), "hi <i>you</i>") + sub("", field(spid=2, showname="s2"), "again") + "<li class='lzl_single_post'>no</li></ul>")
    got = forum.sub_comments(below, forum.comments(of)).orderBy("pos").collect()
    assert [(r.comment_id, r.content, r.user_nickname, r.publish_time, r.parent_comment_id, r.note_id, r.tieba_id) for r in got] == [("1", "hi you", "s1", "2026-03-02", "31", "n0", "8"), ("2", "again", "s2", "2026-03-02", "31", "n0", "8")]


@pytest.mark.parametrize("counts,want", [(2, (7, 9)), (1, (0, 0)), (3, (0, 0))])
def test_creator(spark, counts, want):
    concern = "".join(f'<span class="concern_num">(<a href="#">{n}</a>)</span>' for n in (7, 9, 11)[:counts])
    html = f"""<p class="space"><a href="/home/main?un=%E5%B0%8F&amp;id=tb.9&amp;x=">space</a></p><span class="userinfo_username "> Xiao </span><div class="userinfo_left_head"><a><img src="h.png"></a></div>
    <div class="userinfo_userdata"><span class="sex_male"></span><span>吧龄:5.2年</span> <span>IP属地:上海</span></div>{concern}"""
    r = forum.creators(pages(spark, html), "sex_male", "sex_female").first()
    assert tuple(r)[1:] == ("tb.9", "小", "Xiao", "h.png", "Male", "上海", *want, "5.2年")


def test_thread_ids(spark):
    html = '<ul class="new_list clearfix"><li><div class="thread_name"><a href="/p/11?pid=1">a</a><a href="/p/0">b</a></div></li><li><div class="thread_name"><a href="/p/12">c</a></div></ul><div class="thread_name"><a href="/p/13">d</a></div>'
    assert [r.thread_id for r in forum.thread_ids(pages(spark, html)).orderBy("pos").collect()] == ["11", "12"]


def test_deep_and_broken_pages():
    root = forum.Tree("<div>" * 5000 + "x</b></div>" + "<p>a<p>b<li>c<li>d</p>&amp;").root
    assert root.whole_text() == "xabcd&" and root.markup().count("</div>") == 5000
    assert [e.tag for e in forum.Tree("<ul><li>1<li>2</ul><br>3").root.all()] == ["ul", "li", "li", "br"]

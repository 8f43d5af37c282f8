import hashlib

from loomsight.llm import fixity as f


def pages(spark, rows):
    return spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, file string")


ROWS = [(k * 3, f"http://h/{k}", "é" * (k % 7) + f"<p>{k}</p>") for k in range(2500)] + [(None, "u", "n"), (None, None, None), (9, "again", "z"), (12, "http://h/4", "éééé<p>4</p>"), (-5, "neg", "")]


def digest(p, u, h):
    body = (h or "").encode()
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if p is None else p}>\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return head + body + b"\r\n\r\n"


def test_layout_and_alterations_against_brute_force(spark):
    bad = {30, 33, 6000, 7497}
    other = [(a, b, (c[:-1] + "!" if a in bad and c else c)) for a, b, c in ROWS]
    got = sorted((r.page_id, r.file, r.start, r.length, r.expected, r.found, r.state) for r in f.audit(f.records(pages(spark, ROWS)), f.records(pages(spark, other))).collect())
    files = {}
    for a, b, c in ROWS:
        files.setdefault(-1 if a is None else a // f.FILE_IDS, []).append((a is not None, a or 0, hashlib.sha256((b or "").encode()).hexdigest(), hashlib.sha256(digest(a, b, c)).hexdigest(), a, b, c))
    want = []
    for name, rs in files.items():
        at = 0
        for *_, a, b, c in sorted(rs):
            raw = digest(a, b, c)
            if a in bad:
                want.append((a, name, at, len(raw), hashlib.sha256(raw).hexdigest(), hashlib.sha256(digest(a, b, c[:-1] + "!")).hexdigest(), "altered"))
            at += len(raw)
    assert got == sorted(want)


def test_equal_lost_and_empty(spark):
    a = f.records(pages(spark, ROWS))
    assert f.audit(a, f.records(pages(spark, ROWS[::-1]))).count() == 0
    lost = f.audit(a, f.records(pages(spark, [r for r in ROWS if r[0] != 2997]))).collect()
    assert [(r.page_id, r.state) for r in lost] == [(2997, "missing")]
    extra = f.audit(a, f.records(pages(spark, [*ROWS, (2998, "u", "h")]))).collect()
    assert [(r.page_id, r.state) for r in extra] == [(2998, "extra")]
    none = f.records(pages(spark, ROWS).limit(0))
    assert f.audit(none, none).count() == 0
    assert {r.state for r in f.audit(none, f.records(pages(spark, ROWS[:5]))).collect()} == {"extra"}


def test_loss_in_mid_file_is_one_finding(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>") for k in range(900)]
    a = f.records(pages(spark, rows))
    got = f.audit(a, f.records(pages(spark, [r for r in rows if r[0] != 100]))).collect()
    assert [(r.page_id, r.state, r.place) for r in got] == [(100, "missing", 100)]
    mixed = [(k, u, "x" if k == 500 else h) for k, u, h in rows if k not in (100, 101)] + [(-7, "new", "n")]
    got = f.audit(a, f.records(pages(spark, mixed))).collect()
    assert sorted((r.page_id, r.state) for r in got) == [(-7, "extra"), (100, "missing"), (101, "missing"), (500, "altered")]


def test_null_and_repeated_ids(spark):
    rows = [(None, f"u{k}", f"h{k}") for k in range(300)] + [(None, "same", f"h{k}") for k in range(300)] + [(5, "copy", "c")] * 40 + [(-3, "neg", "n"), (6, "u", "y" * 200_000)]
    a = f.records(pages(spark, rows))
    raw = sorted((p is not None, p or 0, hashlib.sha256(u.encode()).hexdigest(), hashlib.sha256(digest(p, u, h)).hexdigest(), len(digest(p, u, h))) for p, u, h in rows)
    want, at, place = [], {}, {}
    for known, p, _, d, n in raw:
        file = p // f.FILE_IDS if known else -1
        want.append((file, place.get(file, 0), at.get(file, 0), n, d))
        at[file], place[file] = at.get(file, 0) + n, place.get(file, 0) + 1
    assert sorted((r.file, r.place, r.start, r.length, r.digest) for r in a.collect()) == sorted(want)
    other = [r for r in rows if r[1] not in ("u7", "copy")] + [(5, "copy", "c")] * 38
    other = [(p, u, "bad" if h == "h9" else h) for p, u, h in other]
    got = sorted((r.page_id is not None, r.state) for r in f.audit(a, f.records(pages(spark, other))).collect())
    assert got == [(False, "altered"), (False, "altered"), (False, "missing"), (True, "missing"), (True, "missing")]
    assert f.audit(a, f.records(pages(spark, rows[::-1]))).count() == 0


def test_ids_beyond_the_precision_of_doubles(spark):
    ids = [2**62 + 7919 * k for k in range(60)] + [-(2**62) - 7919 * k for k in range(60)]
    rows = [(k, "u", f"h{k}") for k in ids]
    both = f.records(pages(spark, rows))
    kinds = f._kinds(both.withColumn("side", f.F.lit(0)), 0)
    assert kinds.select("i").distinct().count() == len(ids)
    got = f.audit(both, f.records(pages(spark, [(k, u, "x" if k == ids[70] else h) for k, u, h in rows if k != ids[3]]))).collect()
    assert sorted((r.page_id, r.state) for r in got) == sorted([(ids[3], "missing"), (ids[70], "altered")])

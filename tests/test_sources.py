from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.timestamps import pack_py, rendered
from lexigrid.plans.engine import Engine
from lexigrid.plans.request import SearchRequest
from lexigrid.sources import files, markup, stats, synthetic


def test_crawl_and_list(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.go").write_text("one\r\ntwo")
    (tmp_path / "sub" / "b.txt").write_text("three")
    (tmp_path / "c.py").write_text("no")
    (tmp_path / "big.txt").write_text("x" * 200)
    rows = {r["id"]: r for r in files.crawl(spark, str(tmp_path), "m", max_bytes=100, now=7).collect()}
    assert {k.rsplit("/", 1)[1]: r["value"] for k, r in rows.items()} == {"a.go": "one two", "b.txt": "three"}
    assert all(r["ts"] == pack_py(7, 1234) and r["attr"] == "text" for r in rows.values())
    names = tmp_path / "names"
    names.write_text(f"{tmp_path}/a.go\n{tmp_path}/missing.go\n\n")
    assert files.listed(spark, str(names), now=1).count() == 1
    names.write_text(f"file:{tmp_path}/sub/b.txt\n{tmp_path}/a.go\n{tmp_path}/a.go\n/no/such/folder/x.txt\n")
    assert sorted(r["value"] for r in files.listed(spark, str(names), now=1).collect()) == ["one two", "three"]
    names.write_text("")
    assert files.listed(spark, str(names)).count() == 0


def test_html_words(spark):
    page = '<p class="Big">See Example.com/a now</p>'
    words = {r["word"] for r in markup.html_words(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect()}
    assert words == {"p", "big", "see example.com/a now", "example.com", "example.com/a"}


def mail(**headers):
    m = MIMEMultipart()
    m.attach(MIMEText("Grüße from host.example.com", "plain", "utf-8"))
    m.attach(MIMEText("<b>bold</b>", "html", "utf-8"))
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    return m.as_bytes()


def test_mails(spark):
    good = mail(From="Ann <ann@x.org>", To="me@y.org", Cc="z@z.org", Subject="=?utf-8?b?SMOpbGxv?=", Message_Id="<1@x.org>", Date="Thu, 01 Jan 1970 00:01:00 +0000")
    rows = markup.mails(spark.createDataFrame([("p1", bytearray(good)), ("p2", bytearray(mail(Subject="none")))], "path string, content binary")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["mailbox"], r["id"], r["tsec"], r["attrs"]) == ("me@y.org", "1@x.org", 60, {"from": "ann@x.org", "to": "z@z.org"})
    assert {"Héllo", "host.example.com", "b", "bold"} <= set(r["words"])
    assert markup.parse_mail(mail(Message_Id="<1@x.org>"), "box")["mailbox"] == "box"


def test_mails_and_pages_are_indexed(spark, tmp_path):
    good = mail(From="Ann <ann@x.org>", To="me@y.org", Subject="greetings", Message_Id="<1@x.org>", Date="Thu, 01 Jan 1970 00:01:00 +0000")
    undated = mail(To="me@y.org", Message_Id="<2@x.org>")
    e = Engine(spark, f"file://{tmp_path}/ix")
    e.index_values(markup.mail_values(markup.mails(spark.createDataFrame([("p1", bytearray(good)), ("p2", bytearray(undated))], "path string, content binary")), now=500))
    hits = e.search(SearchRequest("me@y.org", {"text": "bold"})).docs
    assert sorted((d["id"], d["ts"], d["key"]) for d in hits) == [("1@x.org", pack_py(60), "p1"), ("2@x.org", pack_py(500), "p2")]
    assert [d["id"] for d in e.search(SearchRequest("me@y.org", {"text": "greetings", "from": "ann x.org"})).docs] == ["1@x.org"]
    e.index_values(markup.html_values(markup.html_words(spark.createDataFrame([(1, "<p class=Big>See now</p>")], "page_id int, html string")), "web", now=7))
    assert [(d["id"], d["ts"]) for d in e.search(SearchRequest("web", {"text": "big now"})).docs] == [("1", pack_py(7))]


def test_recode():
    assert markup.recode("é".encode("latin-1"), "latin-1") == "é"
    assert markup.recode(b"\xe9") == "é" and markup.recode(b"a\0b") == "" and markup.recode(None) == ""
    assert markup.recode(b"ab", "no-such") == "ab" and markup.recode(b"ab", "binary") == ""
    russian, greek, polish, german = "съешь ещё этих мягких французских булок", "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "Zażółć gęślą jaźń, pchnąć w tę łódź jeża", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich"
    for text, charset in ((russian, "cp1251"), (russian, "koi8-r"), (greek, "cp1253"), (polish, "cp1250"), (german, "cp1252"), (russian, "utf-8"), (german, "utf-16-le"), (german, "utf-16-be"), (polish, "utf-16"), (russian, "utf-8-sig")):
        assert markup.recode(text.encode(charset)) == text, charset
    assert markup.detect(bytes(range(256))) is None and markup.detect(b"") == "utf-8"


def test_text_functions(spark):
    df = spark.createDataFrame([("Hé, a@b.co see w.x.org:80/p é\x01",)], "t string")
    r = df.select(T.words("t").alias("w"), T.extracted(F.col("t")).alias("x"), T.printable("t").alias("p"), T.address(F.col("t")).alias("a"), T.key_name(F.lit("b"), F.lit("k")).alias("k"), rendered(F.lit(pack_py(0, 5000))).alias("s")).first()
    assert r["w"] == ["hé", "a", "b", "co", "see", "w", "x", "org", "80", "p", "é"]
    assert set(r["x"]) == {"b.co", "w.x.org:80", "w.x.org:80/p", "a@b.co"}
    assert r["p"] == "H., a@b.co see w.x.org:80/p .." and r["a"] == "a@b.co" and len(r["k"]) == 64
    assert r["s"] == "1970-01-01 00:00:00.000005"
    assert T.words_py("Hé, a") == ["hé", "a"]


def test_synthetic(spark):
    a, b = (sorted(map(str, synthetic.messages(spark, 5, words=20, vocabulary=50).collect())) for _ in range(2))
    assert a == b and len(a) == 5


def test_stats(spark):
    one = '"%s": {"backend_id": %s, "backend": {"config": {"group": %d, "blob_size_limit": %d}, "summary_stats": {"records_total": 9, "records_removed": 2, "base_size": 85}, "vfs": {"blocks": 10, "frsize": 20, "bfree": 3, "bsize": 4}}, "status": {"state": 1, "read_only": false}}'
    text = '{"backends": {%s, %s, %s, "x": {"backend": {}}}}' % (one % ("0", 0, 1, 100), one % ("1", 1, 1, 0), one % ("2", 2, -1, 100))
    rows = stats.backends(spark.createDataFrame([(text,)], "value string"))
    got = {r["backend_id"]: r for r in rows.collect()}
    assert got.keys() == {0, 1} and got[0]["level"] == "soft" and got[1]["size_limit"] == 200 and got[0]["vfs_avail"] == 12
    assert stats.by_group(rows).first()["records_total"] == 18


def test_words_of_few_pages_are_held_at_once(spark, monkeypatch):
    import pyarrow as pa

    pages, got = spark.createDataFrame([("a", "<p>x</p>")], "page_id string, html string"), []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, schema: got.append(run) or self)
    markup.html_words(pages)
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(1000)], "html": [f"<p>w{i}</p>" for i in range(999)] + [None]})
    out = list(got[0](iter([batch])))
    assert max(len(set(b.column("id").to_pylist())) for b in out) <= 64
    assert sorted(zip(*(sum((b.column(c).to_pylist() for b in out), []) for c in ("id", "word")))) == sorted((str(i), w) for i in range(999) for w in ("p", f"w{i}"))


def test_messages_are_hashed_outside_the_plan(spark):
    made = synthetic.messages(spark, 5000, words=3, vocabulary=50)
    assert made.rdd.getNumPartitions() >= 2 and "md5" not in made.select("value")._jdf.queryExecution().optimizedPlan().toString()
    assert len({len(r["value"].split()) for r in made.collect()}) == 1

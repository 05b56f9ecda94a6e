import gzip
import hashlib
import io
import random
import struct
import zipfile

import pytest

from tokenloom.llm import html_crf, warc_zip
from tokenloom.session import shared_folder

PAGE = "page_id bigint, url string, html string, text string, payload_bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "clash", "clash") for row in rows], PAGE)


def archived(spark, frame, **settings):
    folder = f"{shared_folder(spark)}/warc-test-{random.random()}"
    manifest = warc_zip.write_archives(warc_zip.plan_records(frame), folder, **settings)
    return manifest, warc_zip.read_records(warc_zip.read_index(manifest))


def test_archives_give_back_what_they_were_given(spark):
    long, other = "é" * 700, "y" * 1000
    rows = [(1, "http://a/ü?x=1\r\n", long), (2, None, long), (5, "u", long), (3, "u", "short"), (4, "u", "short")]
    rows += [(6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", "z" * 999), (10, "u", "z" * 999), (8, "u", other), (None, "u", long)]
    manifest, records = archived(spark, pages(spark, rows).repartition(3), archive_bytes=600)
    found = records.collect()
    assert manifest.count() > 3 and len(found) == len(rows)
    for row in found:
        html = {1: long, 2: long, 5: long, 3: "short", 4: "short", 6: "", 7: "", 8: other, 9: "z" * 999, 10: "z" * 999, None: long}[row.page_id]
        payload = html.encode()
        assert (row.payload_bytes, row.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        revisit = row.page_id in (1, 2, None)
        assert (row.record_type, row.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert row.payload == (None if revisit else payload)
    assert archived(spark, pages(spark, []))[1].count() == 0


def test_directory_of_zip64_and_commented_files():
    for wide in (False, True):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as archive:
            with archive.open(zipfile.ZipInfo("a/b"), "w", force_zip64=wide) as member:
                member.write(b"first")
            archive.writestr("c", b"second")
            archive.comment = b"PK\x05\x06 in a comment, and more than twenty-two bytes of it: PK\x05\x06"
        size = held.tell()
        members = warc_zip.read_directory(held, size)
        for name, value in (("a/b", b"first"), ("c", b"second")):
            _, packed, full, at = members[name]
            assert packed == full == len(value) and held.getvalue()[at : at + packed] == value
    with pytest.raises(ValueError):
        warc_zip.read_directory(io.BytesIO(b"no archive"), 10)


def test_directory_with_zip64_records():
    name, data = b"m", b"payload"
    local = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(data), len(data), 1, 0) + name + data
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    full = 0xFFFFFFFF
    entry = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, full, full, 1, len(extra), 0, 0, 0, 0, full) + name + extra
    wide = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, full, full, 0)
    held = local + entry + wide + locator + end
    members = warc_zip.read_directory(io.BytesIO(held), len(held))
    assert members == {"m": (0, 7, 7, 31)} and held[31:38] == data


def test_wide_ids_stay_whole(spark):
    wide = [2**53 + 1, 2**53 - 9, 2**63 - 1, -(2**63), 2**53 + 3]
    frame = pages(spark, [(at, "http://h.example/p", "w" * 1200) for at in wide] + [(7, "u", "small"), (None, "u", "small")])
    found = {row.page_id: (row.record_type, row.refers_to) for row in archived(spark, frame)[1].collect()}
    expected = {at: ("revisit", 2**63 - 1) for at in wide}
    assert found == expected | {2**63 - 1: ("response", None), 7: ("response", None), None: ("response", None)}


def test_members_are_found_by_the_directory(spark, tmp_path):
    row = {"html": "body", "record_type": "response", "page_id": 3, "payload_digest": hashlib.sha1(b"body").hexdigest(), "refers_to": None}
    other = row | {"html": "more", "page_id": 4, "payload_digest": hashlib.sha1(b"more").hexdigest()}
    records = [warc_zip.record_bytes(type("Row", (), one | {"url": "http://b.a/x"}), "2020-01-01T00:00:00Z") for one in (row, other)]
    packed = gzip.compress(records[0])
    with zipfile.ZipFile(tmp_path / "own.wacz", "w") as archive:
        archive.writestr("archive/one.warc.gz", packed)
        archive.writestr("archive/two.warc", records[1])
        line = '{"filename": "%s", "offset": %d, "length": "%d"}'
        archive.writestr("indexes/a.cdxj", "a,b)/x 2020 " + line % ("one.warc.gz", 0, len(packed)) + "\n")
        archive.writestr("indexes/b.cdxj.gz", gzip.compress(("!meta {}\na,b)/x 2020 " + line % ("two.warc", 0, len(records[1]))).encode()))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/own.wacz",)], "path string")
    found = warc_zip.read_records(warc_zip.read_index(manifest)).collect()
    assert sorted((r.page_id, r.payload) for r in found) == [(3, b"body"), (4, b"more")]


def test_index_lines_are_sorted_by_key():
    row = type("Row", (), {"url": "http://www.Example.org/a b", "payload_digest": "0" * 40})
    assert warc_zip.index_line(row, 5, 9, "2020-01-02T03:04:05Z").startswith("org,example,www)/a%20b 20200102030405 {")


def texts(markup):
    return [block.text for block in html_crf.leaf_blocks(markup)]


@pytest.mark.parametrize(
    "markup, expected",
    [
        ("<html><head><title>t</title><body><p>a</p><p>b</p>", ["a", "b"]),
        ("<head><meta charset=x><title>t</title><div>a</div>", ["a"]),
        ("<head><style>x</style>loose text<p>a", ["loose text", "a"]),
        ("<head></head><p>a<button>go<p>b</p><div>c</div>", ["a", "b", "c"]),
        ("<p>a</p><button>x<button>y</button><p>b</p>", ["a", "b"]),
        ("<p>a</p><select><option>x<option>y<p>b</p>", ["a", "b"]),
        ("<p>a<svg/>b</p><svg><path d=''/><p>c</p>", ["ab", "c"]),
        ("<p>a</p><svg viewBox='0'><title>no</title></svg><p>b</p>", ["a", "b"]),
        ("<noscript><p>a</p><p>b</p>", ["a", "b"]),
        ("<noscript><p>no</p></noscript><p>b</p><video>no</video>", ["b"]),
        ("<video><p>fallback</p></video><p>b</p>", ["b"]),
    ],
)
def test_pages_without_optional_end_tags(markup, expected):
    assert texts(markup) == expected


def test_damaged_payload_is_noticed(spark):
    row = type("Row", (), {"html": "x" * 50, "record_type": "response", "page_id": 1, "payload_digest": "0" * 40, "url": None, "refers_to": None})
    with pytest.raises(ValueError):
        warc_zip.parse_record(gzip.decompress(gzip.compress(warc_zip.record_bytes(row, "1970-01-01T00:00:00Z"))))


def page(words, chance, body):
    menu = "".join(f"<li><a href=/{at}>{chance.choice(words)}</a></li>" for at in range(5))
    text = "".join(f"<p>{part}</p>" for part in body)
    return (
        f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul>{menu}</ul></nav>"
        f"<div class=ad>{chance.choice(words)} {chance.choice(words)}</div><article><h1>Head {chance.choice(words)}</h1>{text}</article>"
        f"<footer>&copy; {chance.choice(words)}</footer></body></html>"
    )


def test_extraction_of_held_out_pages_and_other_layouts(spark):
    chance = random.Random(9)
    words = [f"word{at}" for at in range(200)]
    bodies = [[" ".join(chance.choices(words, k=chance.randint(5, 60))) + "." for _ in range(chance.randint(1, 8))] for _ in range(120)]
    rows = [(at, f"u{at}", page(words, chance, body)) for at, body in enumerate(bodies)]
    model = html_crf.train_extractor(pages(spark, rows[:80]))
    rows += [(500, None, None), (501, "u", ""), (502, "u", "plain text &amp; no tags"), (503, "u", "<p>un<b>closed <article"), (0, "again", rows[0][2])]
    found = html_crf.extract_text(pages(spark, rows), model).select("page_id", "url", "text", "n_chars").collect()
    assert len(found) == len(rows) and all(row.n_chars == len(row.text) for row in found)
    for row in found:
        if row.page_id < 120:
            head, *body = row.text.split("\n")
            assert head.startswith("Head ") and body == bodies[row.page_id]
    assert [row.text for row in found if row.page_id in (500, 501)] == ["", ""]
    wrong = total = 0
    for at, _, text in rows[80:120]:
        for blocks, labels in html_crf.labelled_pages(text, at):
            wrong += sum(a != b for a, b in zip(html_crf.viterbi(blocks, model), labels, strict=True))
            total += len(labels)
    assert total > 500 and wrong / total < 0.03


def test_blocks_of_markup():
    blocks = html_crf.leaf_blocks("<div>a&nbsp;&lt;b&gt;  c<br>d<b>e</b>f<p>g<p>h<ul><li>i<li>j</ul><script>x<y</script><!-- k -->l &copy")
    assert [block.text for block in blocks] == ["a <b> c def", "g", "h", "i", "j", "l ©"]


def test_extraction_without_pages(spark):
    empty = pages(spark, [])
    assert html_crf.train_extractor(empty) == {}
    assert html_crf.extract_text(empty, {}).count() == 0
    assert html_crf.extract_text(pages(spark, [(1, "u", "<p>a<p>b")]), {}).first().text == "a\nb"

"""Timeline readers and text sinks on small files."""
from shotweave.sources import sinks, timelines

XML = """<?xml version="1.0" encoding="UTF-8"?>
<xmeml version="4"><sequence id="s"><name>n</name><rate><timebase>25</timebase></rate><media><video><track>
<clipitem id="c1"><name>a.mp4</name><rate><timebase>25</timebase></rate><start>0</start><end>50</end><in>25</in><out>75</out>
<file id="f1"><name>a.mp4</name><pathurl>file://localhost/C:/m/a%20b.mp4</pathurl></file><comments><mastercomment1>hello</mastercomment1></comments></clipitem>
<clipitem id="c2"><name>a.mp4</name><rate><timebase>25</timebase></rate><start>50</start><end>75</end><in>0</in><out>25</out><file id="f1"/></clipitem>
</track></video></media></sequence></xmeml>"""


def test_xmeml(spark, tmp_path):
    (tmp_path / "t.xml").write_text(XML)
    got = timelines.read_xmeml(spark, str(tmp_path)).orderBy("rec_in").collect()
    assert [(r.path, r.src_in, r.src_out, r.rec_in, r.rec_out, r.note) for r in got] == [
        ("C:\\m\\a b.mp4", 1.0, 3.0, 0.0, 2.0, "hello"), ("C:\\m\\a b.mp4", 0.0, 1.0, 2.0, 3.0, "")]


def test_edl_file_written_and_read(spark, tmp_path):
    clips = spark.createDataFrame([(1, 0.0, 2.0, 1.0, 3.0, "/m/a.mp4", "a.mp4", "one"), (1, 2.0, 3.0, 0.0, 1.0, "/m/b.mp4", "b.mp4", "two")],
                                  "script_id long, rec_in double, rec_out double, src_in double, src_out double, path string, name string, text string")
    out = str(tmp_path / "edl")
    sinks.write_documents(sinks.edl_rows(clips), out, "script_id", "event", "TITLE: X\nFCM: NON-DROP FRAME\n")
    got = timelines.read_edl(spark, out + "/doc=1").orderBy("rec_in").collect()
    assert [(r.name, r.src_in, r.rec_in, r.rec_out, r.note) for r in got] == [("a.mp4", 1.0, 0.0, 2.0, "one"), ("b.mp4", 0.0, 2.0, 3.0, "two")]

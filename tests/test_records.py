"""Records of one large file, found in byte ranges, against whole-file reading."""

import collections
import json
import os
import random

import pytest

from quillmill.sources import readers, records, schemas

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(params=["20k", "128m"])
def ranges(spark, request):
    """Byte ranges far below a file, some below a record; and one for all."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, (request.param, "100")):
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def texts(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").limit(40).collect()]


def test_wiki_documents_equal_whole_file_reading(spark, texts, tmp_path, ranges):
    odd = "a <doc x\n  see </doc> here\n <docs>\r\nlast"
    parts = [f'{" " * (i % 3)}<doc id="{i}" title="T {i}">\n{t}\n{odd}\n </doc>\n' + "between\n" * (i % 2) for i, t in enumerate(texts)]
    (tmp_path / "wiki_00").write_bytes(("lead\n" + "".join(parts)).encode())
    (tmp_path / "wiki_01").write_bytes("".join(parts[:3]).encode().rstrip())
    (tmp_path / "wiki_02").write_bytes(b"")
    want = collections.defaultdict(list)
    for r in sorted(readers.wiki_lines(spark, str(tmp_path)).collect(), key=lambda r: (r.doc, r.n)):
        want[r.doc.rpartition("#")[0], r.title, r.doc].append(r.line)
    got = records.wiki_documents(spark, str(tmp_path)).orderBy("path", "at", "nth").collect()
    assert sorted((r.path, r.title, list(r.lines)) for r in got) == sorted((p, t, v) for (p, t, _), v in want.items())
    # The order of the file is that of at and nth.
    assert [r.title for r in got if r.path.endswith("00")] == [f"T {i}" for i in range(len(texts))]


@pytest.mark.parametrize("text", ["<doc a>\nx\n<doc b>\ny\n</doc>\n", "</doc>\n<doc b>\ny\n</doc>\n"])
def test_broken_wiki_files_stop(spark, tmp_path, text):
    (tmp_path / "wiki_00").write_text(text)
    with pytest.raises(Exception, match="document"):
        records.wiki_documents(spark, str(tmp_path)).collect()


def test_json_elements_equal_the_parsed_array(spark, texts, tmp_path, ranges):
    rnd = random.Random(1)
    want = [{"title": f't{i} "q\\"}}]}} [{{', "document": [{"section_title": "a{b", "section_body": [t[: rnd.randrange(3000)], "x]}\\", ""]}] * rnd.randrange(3)} for i, t in enumerate(texts)]
    for name, text in (("a", json.dumps(want)), ("b", "\n " + json.dumps(want, indent=1, ensure_ascii=False) + "\n")):
        path = str(tmp_path / f"{name}.json")
        open(path, "w").write(text)
        got = records.json_elements(spark, path, schemas.ARTICLES).orderBy("at", "nth").collect()
        assert [r.element.asDict(True) for r in got] == want
    open(path, "w").write("[ ]\n")
    assert records.json_elements(spark, path, schemas.ARTICLES).collect() == []


@pytest.mark.parametrize("text", ['[{"a":1}', "[1,2]", '[{"a":1}] x', '[{"a":1} {"a":2}]'])
def test_broken_arrays_stop(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        records.json_elements(spark, str(tmp_path / "x.json"), "a int").collect()

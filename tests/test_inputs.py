"""Folders of input files: kinds, faults, backends, streams."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirefold.sources import inputs
from quirefold.streaming.events import run_once

FILES = {
    "a.bin": b"%PDF-1.7\none\ntwo\n\nthree", "b/white.dat": b" \n" * 500 + b"%PDF-1\nx", "c.PNG": b"\x89PNG\r\n\x1a\nrest", "d.jpeg": b"no magic", "e.txt": b"plain text", "empty.pdf": b"", "big.png": b"\x89PNG\r\n\x1a\n" + b"0" * (11 * 1024 * 1024),
    "boom.pdf": b"%PDF-boom", "none.pdf": b"%PDF-none", "odd.pdf": b"%PDF-odd",
}


@pytest.fixture()
def folder(tmp_path):
    for name, content in FILES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    return str(tmp_path / "in")


def backends():
    def reader():
        def predict(content):
            text = content.decode("latin-1")
            if "boom" in text:
                raise RuntimeError("can't read this")
            if "odd" in text:
                return [[{"content": 5}]]
            return [] if "none" in text else [[{"content": line, "bbox": [(0, 1)]} for line in page.split("\n")] for page in text.strip().split("\n\n")]

        return predict

    return {inputs.PDF: ("raster", reader), inputs.PNG: ("raster", lambda: lambda content: [[{"content": "ＡＢ", "label": "title"}]])}


def named(rows):
    return {Path(r.doc_id).name: r for r in rows}


def test_kinds_and_faults(spark, folder):
    got = named(inputs.documents(spark, folder).collect())
    assert {n: r.media_type for n, r in got.items()} == {
        "a.bin": inputs.PDF, "white.dat": inputs.PDF, "c.PNG": inputs.PNG, "d.jpeg": inputs.JPEG, "e.txt": None, "big.png": inputs.PNG, "boom.pdf": inputs.PDF, "none.pdf": inputs.PDF, "odd.pdf": inputs.PDF,
    }
    assert {n: r.error for n, r in got.items() if r.error} == {"e.txt": "unsupported input", "big.png": "the input is too large"}
    assert all((r.content is None) == (r.error is not None) for r in got.values())


def test_bad_documents_stay_alone(spark, folder):
    rows = inputs.recognise(inputs.documents(spark, folder), backends()).collect()
    errors = {Path(r.doc_id).name: r.error for r in rows if r.error}
    assert errors["boom.pdf"] == "RuntimeError: can't read this" and errors["none.pdf"] == "the backend found no pages" and errors["d.jpeg"] == "no backend for image/jpeg"
    assert set(errors) == {"boom.pdf", "none.pdf", "odd.pdf", "d.jpeg", "e.txt", "big.png"} and all(r.page_index is None for r in rows if r.error)
    pages = sorted((Path(r.doc_id).name, r.page_index, [(e.label, e.content) for e in r.elements]) for r in rows if not r.error)
    assert pages == [
        ("a.bin", 0, [("text", "%PDF-1.7"), ("text", "one"), ("text", "two")]), ("a.bin", 1, [("text", "three")]), ("c.PNG", 0, [("title", "AB")]), ("white.dat", 0, [("text", "%PDF-1"), ("text", "x")]),
    ]


def test_files_that_arrive(spark, folder, tmp_path):
    for names in (["a.bin"], ["a.bin", "f.bin"]):
        for n in names:
            if not (Path(folder) / n).exists():
                (Path(folder) / n).write_bytes(b"%PDF-2\nnew")
        run_once(inputs.recognise(inputs.documents(spark, folder, "*.bin", stream=True), backends()), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {Path(r.doc_id).name: r.n for r in got} == {"a.bin": 2, "f.bin": 1}

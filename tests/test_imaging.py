import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import tasks
from lodestone.adapters import plugs
from lodestone.functions import imaging
from lodestone.operators import pii
from lodestone.sources import files


def lines(h=120, w=200):
    """Black bars on white, as lines of writing."""
    page = np.full((h, w), 255, np.uint8)
    for y in range(15, h - 15, 12):
        page[y : y + 5, 20 : w - 20] = 0
    return page


def test_steps_of_the_chain():
    r = np.random.default_rng(0)
    noisy = r.integers(0, 256, (37, 52)).astype(np.uint8)
    near = lambda reach, f: np.array([[f(noisy[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]) for x in range(reach, 52 - reach)] for y in range(reach, 37 - reach)])
    assert (imaging.median(noisy)[1:-1, 1:-1] == near(1, lambda b: int(np.median(b)))).all()
    cross = lambda b: b[[0, 1, 1, 1, 2], [1, 0, 1, 2, 1]]
    assert (imaging.erode(noisy)[1:-1, 1:-1] == near(1, lambda b: cross(b).min())).all() and (imaging.dilate(noisy)[1:-1, 1:-1] == near(1, lambda b: cross(b).max())).all()
    assert (imaging.opened(noisy) <= noisy).all() and (imaging.closed(noisy) >= noisy).all()
    assert imaging.resize(noisy, 26).shape == (18, 26) and imaging.resize(noisy).shape == noisy.shape
    assert (imaging.resize(np.repeat(np.repeat(noisy, 4, 0), 4, 1), 52) == noisy).all()
    assert (imaging.rotate(noisy, 90) == np.rot90(noisy)).all() and (imaging.rotate(noisy, 180) == noisy[::-1, ::-1]).all()
    two = np.where(noisy > 128, 200, 50).astype(np.uint8)
    assert (imaging.otsu(two) == np.where(two > 100, 255, 0)).all()
    smooth = np.add.outer(np.arange(60), np.arange(60)).astype(np.uint8)
    assert np.abs(imaging.bilateral(smooth).astype(int) - smooth)[8:-8, 8:-8].max() <= 1
    step = np.where(np.arange(60)[None, :] < 30, 0, 255).repeat(60, axis=0).astype(np.uint8)
    assert (imaging.bilateral(step) == step).mean() > 0.95
    assert set(np.unique(imaging.adaptive(noisy))) == {0, 255} and (imaging.adaptive(np.full((20, 20), 9, np.uint8)) == 255).all()
    dull = (noisy // 8 + 100).astype(np.uint8)
    assert imaging.equalize(dull).std() > 1.2 * dull.std() and imaging.equalize(dull).shape == dull.shape
    for step_ in (imaging.resize, imaging.median, imaging.prepared):
        with pytest.raises(ValueError):
            step_(np.empty((0, 0), np.uint8))


def test_skew_is_found_and_undone():
    page = lines()
    for degrees in (-7.0, 0.0, 4.5):
        turned = imaging.rotate(page, degrees, 255)
        assert abs(imaging.skew(turned) - degrees) <= 1
    assert imaging.skew(np.full((30, 30), 255, np.uint8)) == 0
    assert imaging.prepared(imaging.rotate(page, 3, 255)).ndim == 2
    assert imaging.prepared(np.dstack([page] * 3)).max() == 255


def test_writing_keeps_the_hull_of_large_regions():
    page = np.zeros((60, 60), np.uint8)
    page[20:40, 20:40] = 255
    page[2, 2] = page[55:58, 3] = 255
    out = imaging.writing(page)
    assert out[30, 30] == 255 and not out[:10].any() and not out[50:].any()
    assert not imaging.writing(np.zeros((9, 9), np.uint8)).any()
    corners = imaging.hull(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [2, 0]]))
    assert {tuple(c) for c in corners.tolist()} == {(0, 0), (4, 0), (4, 4), (0, 4)}


def test_outside_engines(monkeypatch):
    assert plugs.ocr_language("es") == "spa" and plugs.ocr_language("de") == "eng" and pii.NAME_MODELS["it"].startswith("it_")
    made = []
    one = plugs.Clients(lambda e, k: made.append((e, k)) or len(made), ("SOME_ENDPOINT", "SOME_KEY"), key="k")
    with pytest.raises(ValueError, match="SOME_ENDPOINT"):
        one.get()
    assert not one.valid()
    monkeypatch.setenv("SOME_ENDPOINT", "e")
    assert one.get() == one.get() == 1 and made == [("e", "k")] and one.is_ready()
    one.reset()
    assert not one.is_ready() and one.get() == 2
    left = iter([None, None, "done"])
    assert plugs.polled(lambda content, model: lambda: next(left), wait=0.001)(b"", "layout") == "done"
    with pytest.raises(TimeoutError):
        plugs.polled(lambda content, model: lambda: None, wait=0.01, limit=0.02)(b"", "layout")


def test_message_with_attachments_to_report(spark, tmp_path):
    named = lambda n, d: types.SimpleNamespace(longFilename=n, shortFilename=None, name=None, data=d)
    message = types.SimpleNamespace(subject="s", body="Call 555-123-4567 now", sender="a@b.org", to=None, cc=None, bcc=None, date=None, messageId="m", importance=1, attachments=[named("a.txt", b"mail x@y.org"), named("a.txt", b"mail x@y.org"), named("b.zip", b"zz"), named("inner", object())])
    row = plugs.msg_row(message)
    assert [a["is_embedded_email"] for a in row["attachments"]] == [False, False, False, True] and row["importance"] == "1"
    emails = spark.createDataFrame([(1, row["body"], row["attachments"])], f"email_id int, body string, attachments {plugs.ATTACHMENT}")
    read = lambda rows: rows.select("email_id", "pos", "filename", F.col("content").cast("string").alias("text"))
    got = tasks.email_report(emails, read).first()
    assert got.text == "Call 555-123-4567 now\n--- FROM a.txt ---\nmail x@y.org"
    assert got.anonymised == "Call <PHONE_NUMBER> now\n--- FROM a.txt ---\nmail <EMAIL_ADDRESS>"
    many = spark.range(500).selectExpr("id as email_id", "cast(0 as int) as pos", "cast('x' as binary) as content")
    stored = files.write_attachments(many, f"{tmp_path}/att")
    assert stored.columns == ["email_id", "pos", "stored"] and stored.select("stored").distinct().count() <= files.BUCKETS
    where = stored.filter("email_id = 77").first().stored
    assert spark.read.parquet(where).filter("email_id = 77").first().content == b"x"


def test_recognised_texts_are_flagged_and_kept(spark):
    found = spark.createDataFrame([("a", b"known " * 20), ("b", b"qq ww rr " * 20), ("c", b"")], "path string, content binary")
    vocabulary = spark.createDataFrame([("known",)], "word string")

    def make():
        def parse(content):
            if not content:
                raise OSError("no image")
            return [{"text": content.decode()}]

        return parse

    got = {r.path: r for r in plugs.image_texts(found, vocabulary, make).collect()}
    assert got["a"].valid and got["b"].valid is not None and got["c"].error.startswith("OSError") and not got["c"].valid

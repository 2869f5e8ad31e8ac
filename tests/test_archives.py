"""The archive data source against numpy's own files."""

import json
import zipfile

import numpy as np
import pytest

from strataforge.sources import archives
from strataforge.sources.archives import Archive, ArchiveError, _place, archive_problems, key_of, problem_of, read_archives, write_archives

META = {"backbone_id": "dinö 😀", "weights_sha256": "w", "resolution": 224, "preprocess_string": 'p="1"', "compute_dtype": "float32", "manifest_sha256": "m"}


def put(folder, name, n=7, save=np.savez, change=(), dtype="float16", **arrays):
    rng = np.random.default_rng(n)
    own = {"image_id": np.array([f"é{k}" for k in range(n)], str), "sha256": np.array([f"{k:064x}" for k in range(n)], str), "cls": rng.normal(size=(n, 5)).astype(dtype), "meanpatch": rng.normal(size=(n, 3)).astype(dtype)} | arrays
    folder.mkdir(exist_ok=True)
    save(folder / f"{name}.npz", **own)
    meta = {**META, "cache_key": key_of(META), "n_images": n, "token_types": ["cls", "meanpatch"], "shapes": {t: list(own[t].shape) for t in ("cls", "meanpatch")}}
    meta.update(dict(change))
    (folder / f"{name}.meta.json").write_text(json.dumps({k: v for k, v in meta.items() if v != "-"}), encoding="utf-8")
    return own


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_rows_equal_numpys(spark, tmp_path, save, monkeypatch):
    folder = tmp_path / "caches"
    want = {}
    for name, n in (("a", 7), ("b", 1), ("c", 0)):
        own = put(folder, name, n, save)
        want |= {own["image_id"][k]: (own["sha256"][k], own["cls"][k].tolist(), own["meanpatch"][k].tolist(), n) for k in range(n)} if n != 1 else {}
    got = read_archives(spark, str(folder), manifest_sha256="m")
    assert got.columns == ["image_id", "sha256", "cls", "meanpatch"] and got.rdd.getNumPartitions() == 3
    rows = got.collect()
    assert len(rows) == 8
    for r in rows:
        if len({x.image_id for x in rows if x.image_id == r.image_id}) == 1 and r.image_id in want and r.cls == want[r.image_id][1]:
            assert (r.sha256, r.cls, r.meanpatch) == want[r.image_id][:3]
    assert sum(r.cls == want.get(r.image_id, (0, 0))[1] for r in rows) >= 7
    two = read_archives(spark, str(folder), ["meanpatch", "image_id"])
    assert two.columns == ["meanpatch", "image_id"] and sorted(tuple(x) for x in two.collect()) == sorted((r.meanpatch, r.image_id) for r in rows)


def test_only_the_asked_ranges_are_read(tmp_path):
    own = put(tmp_path / "one", "a", 5000)
    place, path = _place(str(tmp_path / "one" / "a.npz"))
    archive = Archive(place, path)
    seen, read = [], archive._read
    archive._read = lambda at, n: seen.append(n) or read(at, n)
    assert (archive.rows("cls", 100, 110) == own["cls"][100:110]).all()
    assert sum(seen) <= 10 * 5 * 2 + 2 * 30 + 128
    assert archive.header("image_id")[1] == (5000,) and set(archive.members) == {"image_id", "sha256", "cls", "meanpatch"}


FAULTS = {
    "lacks_key_field": {"weights_sha256": "-"},
    "wrong_key": {"cache_key": "zz"},
    "other_manifest": {"manifest_sha256": "other"},
    "shape": {"shapes": {"cls": [7, 5], "meanpatch": [7, 4]}},
    "dtype": {"storage_dtype": "float32"},
    "n_images": {"n_images": 8},
}


def test_each_broken_check_gives_its_reason(spark, tmp_path):
    for reason, change in FAULTS.items():
        put(tmp_path / "all", reason, change=change.items())
        put(tmp_path / reason, "x", change=change.items())
        with pytest.raises(Exception, match=reason):
            read_archives(spark, str(tmp_path / reason), manifest_sha256="m").collect()
    put(tmp_path / "all", "good")
    put(tmp_path / "all", "missing")
    (tmp_path / "all" / "missing.meta.json").unlink()
    paths = spark.createDataFrame([(str(tmp_path / "all" / f"{k}.npz"),) for k in (*FAULTS, "good", "missing", "absent")], "path string")
    got = {r.path.rsplit("/", 1)[1].removesuffix(".npz"): r.problem for r in archive_problems(paths, "m").collect()}
    assert got == {k: k for k in FAULTS} | {"missing": "missing", "absent": "missing"}
    # without a manifest that one is no fault
    assert "other_manifest" not in {r.problem for r in archive_problems(paths).collect()}
    assert read_archives(spark, str(tmp_path / "other_manifest")).count() == 7


def test_broken_files_and_unknown_columns(spark, tmp_path):
    put(tmp_path / "cut", "x")
    file = tmp_path / "cut" / "x.npz"
    file.write_bytes(file.read_bytes()[:-40])
    with pytest.raises(Exception, match="no zip directory"):
        read_archives(spark, str(tmp_path / "cut")).collect()
    with pytest.raises(Exception, match="unknown columns"):
        read_archives(spark, str(tmp_path / "cut"), ["pixels"]).collect()
    (tmp_path / "empty").mkdir()
    assert read_archives(spark, str(tmp_path / "empty")).count() == 0
    put(tmp_path / "objects", "x", save=lambda path, **own: np.savez(path, **own))
    with zipfile.ZipFile(tmp_path / "objects" / "x.npz", "a") as z:
        z.writestr("more.npy", b"not an array")
    place, path = _place(str(tmp_path / "objects" / "x.npz"))
    with pytest.raises(ArchiveError, match="no array"):
        Archive(place, path).header("more")


def test_written_archives_are_numpys(spark, tmp_path):
    rows = [(k // 4, f"id{9 - k}", f"s{k}", [k / 2, 1.5], [float(-k)]) for k in range(10)]
    table = spark.createDataFrame(rows, "shard int, image_id string, sha256 string, cls array<float>, meanpatch array<float>")
    for _ in range(2):  # a second run replaces what the first wrote
        assert sorted(r.n_images for r in write_archives(table, str(tmp_path / "out"), "shard", META).collect()) == [2, 4, 4]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{k}{x}" for k in range(3) for x in (".npz", ".meta.json"))
    with np.load(tmp_path / "out" / "1.npz", allow_pickle=False) as z:
        assert z["image_id"].tolist() == ["id2", "id3", "id4", "id5"] and z["cls"].dtype == np.float16 and z["cls"].tolist() == [[3.5, 1.5], [3.0, 1.5], [2.5, 1.5], [2.0, 1.5]]
    back = sorted((r.image_id, r.sha256, r.cls, r.meanpatch) for r in read_archives(spark, str(tmp_path / "out"), manifest_sha256="m").collect())
    assert back == sorted((r[1], r[2], r[3], r[4]) for r in rows)


def test_reasons_in_order():
    meta = {**META, "cache_key": key_of(META), "n_images": 1, "shapes": {"cls": [1, 2], "meanpatch": [1, 2]}}
    arrays = {"cls": ("float16", [1, 2]), "meanpatch": ("float16", [1, 2]), "image_id": ("str", [1]), "sha256": ("str", [1])}
    assert problem_of(meta, arrays, "m") is None and problem_of(None, arrays) == "missing"
    assert problem_of({**meta, "cache_key": "x", "manifest_sha256": "y"}, {}, "m") == "wrong_key"
    assert problem_of(meta, {k: v for k, v in arrays.items() if k != "sha256"}) == "n_images"
    assert archives.sidecar_of("/a/b.npz") == "/a/b.meta.json"

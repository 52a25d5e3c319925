"""Where the recognition program and its data are looked for, on the driver and on executors."""

import os

from folioflow import settings as S
from folioflow.sources import engines


def program(path, version="5.3.1", languages=("eng", "rus")):
    path.parent.mkdir(parents=True, exist_ok=True)
    listed = "\\n".join(["List of available languages (2):", *languages])
    path.write_text(f'#!/bin/sh\ncase "$*" in *--version*) echo "tesseract {version}";; *--list-langs*) printf "{listed}\\n";; esac\n')
    path.chmod(0o755)
    return str(path)


def test_search_order(tmp_path, monkeypatch):
    bundle = tmp_path / "app" / "src" / "bundle"
    bundle.mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    monkeypatch.setenv("PATH", str(tmp_path / "empty") + os.pathsep + "/bin" + os.pathsep + "/usr/bin")
    monkeypatch.chdir(tmp_path / "empty")
    usual = (str(tmp_path / "u" / "first"), str(tmp_path / "u" / "second"))
    seek = lambda **more: engines.probe(S.Settings(**more), str(bundle), usual)
    if not engines.shutil.which("tesseract"):
        assert seek() == engines.EngineInfo()
    second = program(tmp_path / "u" / "second")
    assert seek().path == second
    on_path = program(tmp_path / "empty" / "tesseract")
    assert seek().path == on_path
    own = program(bundle / engines.BUNDLED, "4.0")
    assert (seek().path, seek().version, seek().languages) == (own, "4.0", ("eng", "rus"))
    given = program(tmp_path / "given")
    assert seek(tesseract_path=given).path == given and seek(tesseract_path=str(tmp_path / "none")).path == own
    for place in (tmp_path / "empty" / "runtime" / "tessdata", tmp_path / "empty" / "tessdata", tmp_path / "app" / "runtime" / "tessdata", tmp_path / "app" / "tessdata", bundle.parent / "tessdata", bundle / "tessdata"):
        place.mkdir(parents=True)
        assert seek().data == str(place)
    assert seek(tessdata_dir=str(tmp_path / "none")).data is None and seek(tessdata_dir=str(tmp_path)).data == str(tmp_path)


def test_executors_are_asked(spark, tmp_path):
    given = program(tmp_path / "given", languages=("rus", "osd"))
    found = engines.probe_executors(spark, S.Settings(tesseract_path=given), 3, bundle=str(tmp_path), usual=())
    assert found.count() == 1 and engines.common_info(found) == engines.EngineInfo(given, ("rus", "osd"), None, "5.3.1")
    row = found.first().asDict()
    other = spark.createDataFrame([row, row | {"host": "b", "languages": ["rus"]}], engines.PROBED)
    assert engines.common_info(other).languages == ("rus",)
    assert engines.common_info(spark.createDataFrame([row, row | {"path": None}], engines.PROBED)) == engines.EngineInfo()

"""Command line: spark-submit or python -m folioflow FOLDER."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from folioflow import settings as S
from folioflow.plans.convert import convert_folder, write_results
from folioflow.sources import engines


def main() -> int:
    parser = argparse.ArgumentParser(prog="folioflow", description="Convert a folder of PDF and DOCX files to Markdown.")
    parser.add_argument("folder")
    parser.add_argument("--check", action="store_true", help="tell which engines are there, and stop")
    parser.add_argument("--ocr-languages", type=S.parse_languages, default=("rus", "eng"))
    parser.add_argument("--ocr-workers", type=S.parse_workers, default=S.MAX_WORKERS)
    parser.add_argument("--quality-mode", choices=sorted(S.DPI), default="max")
    parser.add_argument("--tesseract-path")
    parser.add_argument("--tessdata-dir")
    parser.add_argument("--preserve-page-breaks", action="store_true")
    a = parser.parse_args()
    settings = S.Settings(a.ocr_languages, a.ocr_workers, a.quality_mode, a.tesseract_path, a.tessdata_dir, a.preserve_page_breaks)
    started = dt.datetime.now()
    spark = SparkSession.builder.appName("folioflow").getOrCreate()
    found = engines.probe_executors(spark, settings)
    if a.check:
        found.show(truncate=False)
        return 0
    info = engines.common_info(found)
    recogniser = (lambda: engines.Tesseract(info.path, settings.language_argument, info.data)) if info.path else None
    print(write_results(convert_folder(spark, a.folder, settings, recogniser=recogniser, info=info), a.folder, settings, started, info))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

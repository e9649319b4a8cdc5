import os

from checks import registry
from peerscreen.sources import csv as csv_source

SF = "/root/testdata/sf0.001"


def test_intake_keeps_the_bounds_of_uploads(spark, monkeypatch):
    real, asked = csv_source.ingest_files, []

    def told(spark, path, **named):
        asked.append((named, [f for f in os.listdir(path) if f.endswith(".csv")], real(spark, path, **named)))
        return asked[0][2]

    monkeypatch.setattr(csv_source, "ingest_files", told)
    monkeypatch.setattr(registry, "UPLOAD_ROWS", 500)
    monkeypatch.setattr(csv_source, "AT_ONCE", 7)
    n = sum(r.readings for r in registry.QUERIES["A-01_intake_job"](spark, SF).collect())
    named, files, got = asked[0]
    assert named == {} and len(files) >= n / 500 and n == registry.READ(spark, SF).count() and got.errors.isEmpty()

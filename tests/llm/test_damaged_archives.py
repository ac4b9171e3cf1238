"""Damaged archives are errors, wherever the damage is."""

import os

import pytest

from morphlake.llm import warc
from morphlake.llm.common import new_path


@pytest.mark.parametrize("codec", ["gzip", "none"])
def test_damage_is_named(spark, codec):
    rows = [(k, "u", f"payload {k} " * 40) for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, new_path(spark, "warc"), compress=codec)
    links = sorted(r.offset for r in warc.candidate_links(warc._ranges(manifest, 700), 700).collect())
    path = manifest.first()["file"].removeprefix("file://")
    whole = open(path, "rb").read()
    assert warc.read_archives(manifest, split_bytes=700).count() == 50
    for at in (links[0], links[1], links[20], links[21], links[22], links[-1]):
        for k, broken in enumerate((whole[: at + 3] + b"\0" * 20 + whole[at + 23 :], whole[: at + 9])):
            with open(path, "wb") as f:
                f.write(broken)
            with pytest.raises(Exception, match=os.path.basename(path)):
                warc.read_archives(manifest, split_bytes=700 if k else 1 << 20).collect()
            if os.path.exists(crc := os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")):
                os.remove(crc)
    with open(path, "wb") as f:
        f.write(whole)
    assert warc.read_archives(manifest).count() == 50

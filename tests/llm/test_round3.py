"""Names of sibling licenses, and shards that are written twice."""

import shutil

import public_tokenizers as P
import pytest

from cellspark.llm import licenses, shards

INDEX = licenses.Index(licenses.TEMPLATES)
PREAMBLE = next(t for name, t, _ in licenses.TEMPLATES if name == "BSD-family")


def names(text):
    return [x["license"] for x in licenses.scan_text(text, INDEX)]


@pytest.mark.parametrize("short, right", [("BY", []), ("BY-NC", ["CC-BY-NC-4.0"]), ("BY-ND", []), ("BY-NC-ND", []), ("BY-NC-SA", []), ("BY-SA", [])])
def test_short_names_of_siblings(short, right):
    """None is taken for a sibling; a short name without a template is in no row."""
    assert names(f"Text is Licensed under CC {short} 4.0. More.") == right


def test_siblings_of_the_gpl_are_not_the_gpl():
    grant = next(t for name, t, _ in licenses.TEMPLATES if name == "GPL-2.0")
    for word in ("Library", "Lesser", "Affero"):
        assert "GPL-2.0" not in names(grant.replace("GNU General", f"GNU {word} General"))


def test_a_shared_preamble_is_no_certain_license():
    assert names(f"{PREAMBLE} 1. Keep the notice. 2. The end-user documentation must say so.") == ["BSD-family"]


def test_shards_are_not_written_twice(spark, tmp_path):
    at = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    write = lambda path: shards.write_shards(at, path, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 8, 50256, 3, 4096)
    layout = write(f"{tmp_path}/a")
    with pytest.raises(FileExistsError):
        write(f"{tmp_path}/a")
    assert shards.read_shards(spark, f"{tmp_path}/a", layout).count() == layout.size == 9
    write(f"{tmp_path}/b")
    for f in (tmp_path / "b" / "shard=0").glob("part-*"):
        shutil.copy(f, tmp_path / "a" / "shard=0")
    with pytest.raises(ValueError, match="two files"):
        shards.read_shards(spark, f"{tmp_path}/a", layout)

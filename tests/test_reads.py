"""What queries use several times is read from a written table, not worked out from the texts anew."""

from pathlib import Path

import pytest

from rulelens.sources.readings import read_words

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_readings_are_written_once(spark):
    files = read_words(spark, SF).inputFiles()
    assert files and not [f for f in files if "documents" in f]

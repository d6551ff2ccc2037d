"""The shared folder is never a local one on a cluster."""

from types import SimpleNamespace

import pytest

from equity_jobs.sources.shared import shared_dir


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1000]"])
def test_unset_folder_raises_on_a_cluster(master):
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session, "any")


def test_local_master_has_a_folder(spark):
    assert "/any-" in shared_dir(spark, "any")

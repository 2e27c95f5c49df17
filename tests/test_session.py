import pytest

from docloom.session import own_dir


def test_a_cluster_needs_a_shared_folder():
    assert "spark-docloom-" in own_dir("local[8]")
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            own_dir(master)

import hashlib
import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def stand_in_embedder(dim):
    """In place of a model: vectors drawn from a generator whose seed is a digest of the text."""

    def embed(texts):
        seeds = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8]) for t in texts]
        return np.stack([np.random.default_rng(s).normal(size=dim) for s in seeds]).astype(np.float32)

    return embed

"""python -m forkscope: synthetic workloads and corpora from the command line."""

from __future__ import annotations

import argparse
import json

from .plans import runner
from .plans.workload import Config, DEFAULT_SEED, Kind
from .session import local_session
from .sources import manifests


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="forkscope")
    p.add_argument("--workload", choices=[k.value for k in Kind], default=Kind.SMALL_EDIT.value)
    p.add_argument("--branches", type=int, default=1000)
    p.add_argument("--base-mib", type=lambda x: int(x) << 20, dest="base_bytes", default=2 << 20)
    p.add_argument("--base-kib", type=lambda x: int(x) << 10, dest="base_bytes", default=argparse.SUPPRESS)
    p.add_argument("--edit-bytes", type=int, default=96)
    p.add_argument("--read-bytes", type=int, default=4096)
    p.add_argument("--leaf-bytes", type=int, default=4096)
    p.add_argument("--verify-samples", "--samples", type=int, default=16)
    p.add_argument("--seed", type=lambda x: int(x, 0), default=DEFAULT_SEED)
    p.add_argument("--avg-chunk-bytes", "--chunk-average", type=int, default=4096)
    p.add_argument("--corpus-manifest")
    found = p.parse_args(argv)
    if found.leaf_bytes < 1:
        p.error("--leaf-bytes must be positive")
    if found.avg_chunk_bytes < 64:
        p.error("--avg-chunk-bytes must be at least 64")
    return found


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = local_session()
    if a.corpus_manifest:
        found = runner.run_corpus(manifests.read_pairs(spark, a.corpus_manifest), average=a.avg_chunk_bytes, read_bytes=a.read_bytes, verify_samples=a.verify_samples, leaf=a.leaf_bytes)
    else:
        config = Config(Kind(a.workload), a.branches, a.base_bytes, a.edit_bytes, a.read_bytes, a.verify_samples, a.seed)
        found = runner.run_workload(spark, config, a.avg_chunk_bytes, a.leaf_bytes)
    print(json.dumps(found, indent=1))

"""Parameters of a job: fields with types, from the environment and the command line."""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

PREFIX = "MILLRACE_"


@dataclass(frozen=True)
class Config:
    """A job's parameters. A field is read from PREFIX and its name in capitals; a flag of its name goes before that."""

    data_dir: str = "data/processed"
    max_len: int = 4096
    num_shards: int = 1
    shard_index: int = 0
    seed: str = "42"
    test_share: float = 0.05
    val_share: float = 0.10

    def __post_init__(self):
        if not 0 <= self.shard_index < self.num_shards:
            raise ValueError("shard_index is from 0 to num_shards - 1")
        if self.max_len < 1 or min(self.test_share, self.val_share) < 0 or self.test_share + self.val_share >= 1:
            raise ValueError("max_len is at least 1; shares are not negative and leave something for training")

    @classmethod
    def read(cls, args: list[str] | None = None, env: Mapping[str, str] | None = None) -> Config:
        """From flags such as --max-len, then the environment, then the defaults; an unknown flag or a wrong type is an error."""
        env, parser, given = os.environ if env is None else env, argparse.ArgumentParser(), {}
        for f in fields(cls):
            kind = type(f.default)
            parser.add_argument("--" + f.name.replace("_", "-"), type=kind)
            if PREFIX + f.name.upper() in env:
                given[f.name] = kind(env[PREFIX + f.name.upper()])
        return cls(**given | {k: v for k, v in vars(parser.parse_args(args or [])).items() if v is not None})

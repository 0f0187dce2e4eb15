"""A small synthetic chain for tests: blocks with hashes by height and branch."""

from pyspark.sql import Row

from ledgerloom.schema import ddl


def block_hash(height: int, branch: int = 0) -> str:
    return f"{(height * 0x9E3779B9 & 0xFFFFFFFF) ^ branch:08x}" * 8


def epoch_row(epoch: int, tip: int, branch: int = 0, finalized: int = 0, **more) -> Row:
    values = dict(epoch=epoch, network=3, tip_height=tip, tip_hash=block_hash(tip, branch), finalized_height=finalized, finalized_hash=block_hash(finalized), artifact_schema_version=2, created_at_millis=1_774_668_500_000 + epoch, sapling_tree_size=0, orchard_tree_size=0)
    return Row(**(values | more))


class Chain:
    def __init__(self, spark):
        self.spark = spark

    def table(self, name, rows):
        from ledgerloom.schema import schema

        names = [f.name for f in schema(name).fields]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl(name))

    def blocks(self, start, end, branch=0, base=None):
        """Block and compact rows; the first one's parent is on branch ``base``."""
        rows = []
        for h in range(start, end + 1):
            below = branch if h > start or base is None else base
            rows.append(dict(epoch=0, height=h, block_hash=block_hash(h, branch), parent_hash=block_hash(h - 1, below), payload=f"block-{h}-{branch}".encode()))
        return {"block": self.table("block", rows), "compact_block": self.table("compact_block", [{k: r[k] for k in ("height", "block_hash")} | {"vtx": []} for r in rows])}

    def output(self, txid, index, value, height, branch=0, script="aa"):
        return dict(script_hash=script * 32, script="00", txid=txid * 32, output_index=index, value_zat=value, height=height, block_hash=block_hash(height, branch))

    def spend(self, txid, index, height, branch=0):
        return dict(txid=txid * 32, output_index=index, height=height, block_hash=block_hash(height, branch))

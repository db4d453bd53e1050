"""A folder of chunks named by their SHA-256, as a Spark data source.

``spark.dataSource.register(ChunkStore)``, then ``spark.read.format("chunk_store").load(folder)`` gives (hash, size,
content). Chunks lie in sub-folders named by the first hex digit; each is a partition. The folder is a URI that
pyarrow's file systems open, and must be reachable from every executor. Files whose name is no hash are left out;
content that does not match its name is an error.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_HASH = re.compile("[0-9a-f]{64}")


class ChunkStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_store"

    def schema(self) -> str:
        return "hash string, size bigint, content binary"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options["path"])


class ChunkReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(digit) for digit in "0123456789abcdef"]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        for info in files.get_file_info(fs.FileSelector(f"{root}/{partition.value}", allow_not_found=True)):
            if info.is_file and _HASH.fullmatch(info.base_name):
                with files.open_input_stream(info.path) as f:
                    content = f.read()
                if hashlib.sha256(content).hexdigest() != info.base_name:
                    raise ValueError(f"chunk {info.base_name} does not match its name")
                yield info.base_name, len(content), content


def store_chunks(rows, content: str, folder: str) -> None:
    """Write each distinct content of a DataFrame into the folder, by its hash; those that are there stay."""

    def put(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                h = hashlib.sha256(c).hexdigest()
                at = f"{root}/{h[0]}/{h}"
                if files.get_file_info(at).type == fs.FileType.NotFound:
                    files.create_dir(f"{root}/{h[0]}", recursive=True)
                    # whole files appear at once, so a lost or repeated task leaves no half chunk
                    with files.open_output_stream(f"{at}.{id(batch):x}.part") as f:
                        f.write(c)
                    files.move(f"{at}.{id(batch):x}.part", at)
            yield batch.slice(0, 0)

    some = rows.where(f"`{content}` IS NOT NULL").selectExpr(f"CAST(`{content}` AS BINARY) AS c").distinct()
    some.mapInArrow(put, "c binary").count()

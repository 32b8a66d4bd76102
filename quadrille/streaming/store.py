"""View stores: a Parquet folder per version and a manifest that names the current one.

A new version is written whole before the manifest points to it, so readers never see a half
view and a lost job leaves the old one. All file work goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import PanelError
from ..sources.config import PROVIDERS_GROUP, Config, resolve
from ..sources.names import VIEWS

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Manifest:
    name: str
    kind: str
    exports: tuple[str, ...]
    columns: tuple[str, ...]
    recipe: str
    config: str
    freshness: dict[str, str | None]
    groups: dict[str, str] = field(default_factory=dict)
    deps: dict[str, str] = field(default_factory=dict)
    frequency: str | None = None
    version: str = ""
    built_at: str = ""

    @property
    def fingerprint(self) -> str:
        return f"{self.recipe}:{self.version}"


def checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise PanelError("E-VIEW-NAME", f"bad view name {name!r}")
    return name


def view_columns(kind: str, name: str, exports: tuple[str, ...]) -> tuple[str, ...]:
    return (f"{VIEWS}.{name}",) if kind == "signal" else tuple(f"{VIEWS}.{name}.{e}" for e in exports)


class ViewStore(ABC):
    @abstractmethod
    def read(self, name: str) -> DataFrame | None: ...

    @abstractmethod
    def manifest(self, name: str) -> Manifest | None: ...

    @abstractmethod
    def write(self, name: str, frame: DataFrame, manifest: Manifest) -> Manifest: ...

    @abstractmethod
    def delete(self, name: str) -> bool: ...

    @abstractmethod
    def list(self) -> list[str]: ...


class ParquetStore(ViewStore):
    """options.dir: a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, options: dict):
        if not options.get("dir"):
            raise PanelError("E-PROVIDER-OPTIONS", "the view store needs options.dir")
        self.spark, self.dir = spark, str(options["dir"]).rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.dir, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self, name: str) -> list[str]:
        """File names of the view's manifests, in the order in which they were written."""
        fs, at = self._fs(), self._path(checked(name))
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in found if n.startswith("manifest-") and n.endswith(".json"))

    def _parsed(self, name: str, file: str) -> Manifest:
        raw = json.loads(self.spark.read.text(self._path(name, file).toString(), wholetext=True).first()[0])
        return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def manifest(self, name: str) -> Manifest | None:
        files = self._manifests(name)
        return self._parsed(name, files[-1]) if files else None

    def read(self, name: str) -> DataFrame | None:
        m = self.manifest(name)
        return None if m is None else self.spark.read.parquet(f"{self.dir}/{name}/{m.version}")

    def write(self, name: str, frame: DataFrame, manifest: Manifest) -> Manifest:
        """A new version counts from the moment its manifest has its name. The version before it stays for those who
        are reading it; what is older is deleted."""
        version = uuid.uuid4().hex
        frame.write.parquet(f"{self.dir}/{checked(name)}/{version}")
        done = Manifest(**(asdict(manifest) | {"version": version}))
        files = self._manifests(name)
        number = int(files[-1].split("-")[1]) + 1 if files else 0
        fs, text = self._fs(), json.dumps(asdict(done))
        draft = self._path(name, f"draft-{version}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(draft, self._path(name, f"manifest-{number:012d}-{version}.json"))
        for file in files[:-1]:
            fs.delete(self._path(name, file.removesuffix(".json").split("-")[2]), True)
            fs.delete(self._path(name, file), False)
        return done

    def delete(self, name: str) -> bool:
        return bool(self._fs().delete(self._path(checked(name)), True))

    def list(self) -> list[str]:
        fs, at = self._fs(), self._path()
        if not fs.exists(at):
            return []
        return sorted(n for s in fs.listStatus(at) if s.isDirectory() and self.manifest(n := s.getPath().getName()) is not None)


def store_of(spark: SparkSession, config: Config) -> ViewStore:
    """The store that the config names under providers.views, by default a folder beside the config."""
    spec = config.providers.get("views")
    if spec is None:
        folder = os.path.dirname(config.path) if config.path else os.getcwd()
        return ParquetStore(spark, {"dir": f"file://{folder}/.quadrille/views"})
    return resolve(spec.driver, PROVIDERS_GROUP, {"parquet": ParquetStore, "views": ParquetStore}, "E-PROVIDER-DRIVER")(spark, spec.options)

"""The dataflow from sources to versions, as lazily evaluated tables that share one parse."""

from __future__ import annotations

import dataclasses
import functools

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import convert, depgraph, model, report, risk, splitter, versions


@dataclasses.dataclass
class Project:
    """Tables derived from source rows (project_id, source_project_id, input_source_id, source_path, original_text)."""

    sources: DataFrame
    #: Whether conversions are stored with their SQL text; who reads only ids, levels or states once is faster without.
    keep_conversions: bool = True
    #: Whether the parse is stored; who reads one of its tables once is faster without, and only makes the columns that are read.
    keep_parse: bool = True

    @functools.cached_property
    def classified(self) -> DataFrame:
        """Split and classified once for all tables below, unless told otherwise; what is lost with an executor is computed again from the sources."""
        made = model.classify(splitter.split_statements(self.sources))
        return made.persist(StorageLevel.MEMORY_AND_DISK) if self.keep_parse else made

    def release(self) -> None:
        for name in ("classified", "conversions"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @functools.cached_property
    def objects(self) -> DataFrame:
        return model.objects(self.classified)

    @functools.cached_property
    def issues(self) -> DataFrame:
        return model.parse_issues(self.classified)

    @functools.cached_property
    def parts(self) -> DataFrame:
        return model.table_parts(self.objects)

    @functools.cached_property
    def columns(self) -> DataFrame:
        return model.columns(self.parts)

    @functools.cached_property
    def risks(self) -> DataFrame:
        return risk.assess(self.objects)

    @functools.cached_property
    def conversions(self) -> DataFrame:
        """Kept like the parse, unless told otherwise: versions, reports and advice all read it, and making it takes Python."""
        made = convert.convert_with_extensions(self.objects, self.parts)
        return made.persist(StorageLevel.MEMORY_AND_DISK) if self.keep_conversions else made

    @functools.cached_property
    def versions(self) -> DataFrame:
        return versions.generated(self.conversions)

    @functools.cached_property
    def edges(self) -> DataFrame:
        return depgraph.dependencies(self.objects)

    @functools.cached_property
    def precheck(self) -> DataFrame:
        return report.precheck(self.objects, self.issues, self.risks, self.conversions, self.versions)

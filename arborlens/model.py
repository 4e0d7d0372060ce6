"""The property graph: two DataFrames, their schemas and vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels of nodes, types of relationships, kinds of imports.
LABELS = ["Project", "Package", "Module", "Folder", "File", "Class", "Function", "Method", "Variable", "Interface", "Enum", "Decorator", "Import", "Type", "CodeElement"]
TYPES = ["CONTAINS", "CALLS", "INHERITS", "OVERRIDES", "IMPORTS", "USES", "DEFINES", "DECORATES", "IMPLEMENTS", "ACCESSES", "EXTENDS", "BELONGS_TO"]
IMPORT_KINDS = ["default", "named", "namespace", "dynamic"]
#: What the narrow validation accepts.
STRICT_LABELS = [x for x in LABELS if x not in ("Import", "Type", "CodeElement")]
STRICT_TYPES = [x for x in TYPES if x not in ("EXTENDS", "BELONGS_TO")]

NODE_DDL = (
    "id string, label string, name string, path string, filePath string, extension string, language string, size long, "
    "lineCount long, definitionCount long, type string, startLine long, endLine long, qualifiedName string, "
    "parameters array<string>, returnType string, accessibility string, isStatic boolean, isAsync boolean, parentClass string, "
    "decorators array<string>, extends array<string>, implements array<string>, importPath string, exportType string, "
    "docstring string, depth int, description string, version string, ord long, extras map<string,string>"
)
EDGE_DDL = (
    "id string, type string, src string, dst string, strength double, confidence double, importType string, alias string, "
    "localName string, exportedName string, callType string, functionName string, arguments array<string>, "
    "dependencyType string, version string, filePath string, line_number long, startLine long, endLine long, "
    "resolutionStage string, ord long, extras map<string,string>"
)


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, in order; those that are missing are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _schema(ddl)])


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes (id, label, properties, ord) and edges (id, type, src, dst, properties, ord)."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph(conform(nodes, NODE_DDL), conform(edges, EDGE_DDL))

    @staticmethod
    def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> PropertyGraph:
        """A small graph; ``ord`` is the place in the lists."""
        n, e = _schema(NODE_DDL), _schema(EDGE_DDL)
        row = lambda schema, d, k: tuple(d.get(f.name, k if f.name == "ord" else None) for f in schema)
        return PropertyGraph(spark.createDataFrame([row(n, d, k) for k, d in enumerate(nodes)], n), spark.createDataFrame([row(e, d, k) for k, d in enumerate(edges)], e))

    def views(self, prefix: str = "") -> None:
        """Temp views for SQL: ``nodes`` and ``edges``."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")


@dataclass(frozen=True)
class GraphResult:
    """Rows of a query, and the nodes and edges among them; nothing is computed before it is read."""

    data: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None

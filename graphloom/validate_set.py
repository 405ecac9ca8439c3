"""Whether a set is ready: python -m graphloom.validate_set SETTINGS NAME [FOLDER].

SETTINGS is a YAML or JSON file with sets, sets_by_type and encoders; FOLDER has the set's parsed documents.
Problems are printed with numbers; the exit code is 1 if there are any.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .operators.validate import validate
from .sources import readers, sinks

_DOCUMENT = "title string, text map<string,string>, image map<string,string>"


def report(problems: list[str]) -> tuple[str, int]:
    """Numbered lines, and the exit code."""
    if not problems:
        return "no problems", 0
    return "\n".join(f"{k}. {p}" for k, p in enumerate(problems, 1)), 1


def main(spark: SparkSession, args: list[str]) -> int:
    settings = sinks.read_settings(spark, args[0])
    documents = readers.read_documents(spark, args[2], _DOCUMENT) if len(args) > 2 else None
    found = validate(spark, args[1], settings.get("sets", {}), settings.get("sets_by_type", {}), settings.get("encoders", {}), documents)
    text, code = report([r.problem for r in found.orderBy("problem").limit(1000).collect()])
    print(text)
    return code


if __name__ == "__main__":
    if len(sys.argv) not in (3, 4):
        sys.exit(__doc__)
    sys.exit(main(SparkSession.builder.getOrCreate(), sys.argv[1:]))

"""python -m rivulet.cli script=path [config=path] [stream=true] [name=value ...]"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from rivulet.config import Config
from rivulet.errors import FlowError
from rivulet.session import Session


def main(argv: list[str]) -> int:
    given = dict(a.partition("=")[::2] for a in argv if "=" in a)
    if "script" not in given:
        print(__doc__, file=sys.stderr)
        return 2
    script, config, stream = given.pop("script"), given.pop("config", None), given.pop("stream", "false")
    session = Session(SparkSession.builder.getOrCreate(), stream.lower() == "true", Config.read(config) if config else None)
    try:
        session.run(Path(script).read_text() if script != "-" else sys.stdin.read(), given)
        session.wait()
    except FlowError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

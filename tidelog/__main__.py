"""python -m tidelog ddl LOCATION | events PACKAGE: the tables' DDL, or the events of a package."""

from __future__ import annotations

import argparse
import os


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    d = commands.add_parser("ddl", help="write the DDL of the four tables")
    d.add_argument("location")
    d.add_argument("-output", default="-")
    e = commands.add_parser("events", help="list the event types of a package with their versions")
    e.add_argument("package")
    args = parser.parse_args(argv)
    if args.command == "ddl":
        from tidelog.schema import ddl

        text = ddl(args.location)
        if args.output == "-":
            print(text)
        else:
            os.makedirs(os.path.dirname(os.path.abspath(args.output)), mode=0o755, exist_ok=True)
            with os.fdopen(os.open(args.output, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as out:
                out.write(text)
        return 0
    from tidelog.functions.codec import Registry

    for name, versions in sorted(Registry.discover(args.package).types.items()):
        print(name, *sorted(versions))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m ampliq [options] [file or -]: clusters a FASTA file with the usual option letters."""

from __future__ import annotations

import getopt
import re
import sys

from pyspark.sql import SparkSession

from ampliq import __version__
from ampliq.plans.options import AmpliconError, Options
from ampliq.plans.run import Run
from ampliq.sinks.text import write_file
from ampliq.sources.fasta import line_of, read_fasta

_LONG = {
    "d": "differences=", "n": "no-otu-breaking", "f": "fastidious", "b": "boundary=", "c": "ceiling=", "y": "bloom-bits=", "a": "append-abundance=", "z": "usearch-abundance",
    "m": "match-reward=", "p": "mismatch-penalty=", "g": "gap-opening-penalty=", "e": "gap-extension-penalty=", "x": "disable-sse3", "t": "threads=",
    "i": "internal-structure=", "j": "network-file=", "l": "log=", "o": "output-file=", "r": "mothur", "s": "statistics-file=", "u": "uclust-file=", "w": "seeds=", "h": "help", "v": "version",
}
_FIELDS = {"d": "d", "b": "boundary", "c": "ceiling", "y": "bloom_bits", "a": "default_abundance", "m": "match", "p": "mismatch", "g": "gap_open", "e": "gap_extend", "t": "threads"}
_FLAGS = {"f": "fastidious", "z": "usearch", "x": "disable_sse3"}
_FILES = {"i": "structure", "j": "network", "l": "log", "s": "statistics", "u": "uclust", "w": "seeds"}


def parse(args: list[str]) -> tuple[dict[str, str], list[str]]:
    """(letter -> value, files). An option given twice or unknown is an AmpliconError."""
    short = "".join(k + (":" if v.endswith("=") else "") for k, v in _LONG.items())
    try:
        found, files = getopt.gnu_getopt(args, short, list(_LONG.values()))
    except getopt.GetoptError as e:
        raise AmpliconError(str(e)) from None
    names = {"--" + v.rstrip("="): k for k, v in _LONG.items()} | {"-" + k: k for k in _LONG}
    out: dict[str, str] = {}
    for name, value in found:
        if names[name] in out:
            raise AmpliconError(f"option -{names[name]} is given more than once")
        out[names[name]] = value
    return out, files


def options(given: dict[str, str]) -> Options:
    """The run options of the letters, checked."""
    values: dict = {}
    for k, name in _FIELDS.items():
        if k in given:
            try:
                values[name] = int(re.fullmatch(r"[+-]?[0-9]+", given[k])[0])
            except TypeError:
                raise AmpliconError(f"invalid number for -{k}: {given[k]}") from None
    values |= {name: True for k, name in _FLAGS.items() if k in given}
    return Options(breaking="n" not in given, network="j" in given, **values).checked()


def main(args: list[str]) -> int:
    try:
        given, files = parse(args)
        if "h" in given or "v" in given:
            print(f"ampliq {__version__}\n" + ("" if "v" in given else __doc__ + "\n" + "\n".join(f"  -{k} --{v.rstrip('=')}" for k, v in _LONG.items())))
            return 0
        chosen = options(given)
        spark = SparkSession.builder.appName("ampliq").getOrCreate()
        try:
            run = Run(read_fasta(spark, files or ["-"]).select("header", "sequence"), chosen)
        except AmpliconError as e:
            at = line_of(spark, files, e.header) if e.header is not None and files and files != ["-"] else None
            raise AmpliconError(f"{e}, {at[0]}, line {at[1]}") from None if at else e
        write_file(run, "mothur" if "r" in given else "clusters", given.get("o", "-"))
        for letter, output in _FILES.items():
            if letter in given:
                write_file(run, output, given[letter])
        return 0
    except AmpliconError as e:
        print(f"\nError: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

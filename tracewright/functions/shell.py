"""Predicates on command lines and the programs that run them. All run in the JVM; null commands fulfil none."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of programs and folders that the predicates know.
SHELLS = ("sh", "bash", "dash", "zsh", "ksh", "ash", "mksh", "fish")
NETCATS = ("nc", "ncat", "netcat", "nc.traditional", "nc.openbsd")
INTERPRETERS = ("python", "perl", "ruby", "php", "node", "lua")
OPEN_DIRS = ("/tmp/", "/var/tmp/", "/dev/shm/")
WRAPPERS = ("nohup", "setsid", "exec", "env", "sudo", "nice", "ionice", "stdbuf")
DOWNLOADERS = ("curl", "wget", "fetch")
SPAWNING = ("pty", "subprocess", "dup2", "/bin/sh", "/bin/bash", "exec", "spawn", "sh -i")

#: What stands between the words of a command, and what a word is made of.
GAP = r"[\s'\"(){}`|;&<>]"
LETTER = r"[^\s'\"(){}`|;&<>]"
FIRST, LAST = f"(?:^|(?<={GAP}))", f"(?=$|{GAP})"


def either(*texts: str) -> str:
    return "(?:" + "|".join(map(re.escape, texts)) + ")"


def program(*names: str, begun: bool = False) -> str:
    """A word that is one of the programs, with or without its folder; begun: or begins as one does."""
    return f"{FIRST}(?:{LETTER}*/)?{either(*names)}{f'[^/\\s\'\"(){{}}`|;&<>]*' if begun else ''}{LAST}"


ANY_SHELL, ANY_NETCAT, ANY_INTERPRETER = program(*SHELLS), program(*NETCATS), program(*INTERPRETERS, begun=True)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?s){pattern}")


def tail(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def has(text: Column, *parts: str) -> Column:
    """Whether text contains any of the parts."""
    return matches(text, either(*parts))


def begins(text: Column, *heads: str) -> Column:
    return matches(text, "^" + either(*heads))


def is_shell(name: Column) -> Column:
    return tail(name).isin(*SHELLS)


def is_interpreter(name: Column) -> Column:
    return begins(tail(name), *INTERPRETERS)


def in_open_dir(path: Column) -> Column:
    return begins(path, *OPEN_DIRS)


#: Words that stand before the program that a part of a command line runs: wrappers and shells, options, assignments.
BEFORE = f"(?:{program(*WRAPPERS, *SHELLS)}|{FIRST}-{LETTER}*{LAST}|{FIRST}(?!/){LETTER}*={LETTER}*{LAST})"


def executed(command: Column) -> Column:
    """The program that each part of a command line runs, behind wrappers, options and assignments."""
    first = lambda part: F.regexp_extract(part, f"(?s)^{GAP}*(?:{BEFORE}{GAP}+)*+({LETTER}+)", 1)
    behind = lambda part: F.regexp_replace(part, f"(?s)^{GAP}*(?:{BEFORE}(?:{GAP}+|$))+", "")
    return F.filter(F.transform(F.split(command, "[;&|\n]"), lambda part: first(behind(part))), lambda p: p != "")


def runs_from_open_dir(command: Column) -> Column:
    return F.exists(executed(command), in_open_dir)


#: A download, a pipe behind it, and a shell or an interpreter as the first program behind that or a later pipe.
PIPED = f"{program(*DOWNLOADERS)}.*\\|{GAP}*(?:(?:{program('sudo', 'env')}|{FIRST}-{LETTER}*{LAST}){GAP}+)*(?:{ANY_SHELL}|{ANY_INTERPRETER})"


def pipes_download(command: Column) -> Column:
    """Whether a download is piped, at once or later on, into a shell or an interpreter."""
    return matches(command, PIPED)


@dataclass(frozen=True)
class Family:
    """Reverse shells of one kind: patterns that a command has, all of them, and those of programs that may run it, any of them."""

    name: str
    signs: tuple[str, ...]
    actors: tuple[str, ...]


FAMILIES = (
    Family("device", (either("/dev/tcp/", "/dev/udp/"),), (ANY_SHELL,)),
    Family("netcat", (f"{ANY_NETCAT}.*{FIRST}(?:{either('--exec', '--sh-exec', '--lua-exec')}|-(?!-){LETTER}*[ec]{LETTER}*){LAST}",), (ANY_NETCAT, ANY_SHELL)),
    Family("fifo", (ANY_NETCAT, either("mkfifo", "mknod")), (ANY_SHELL,)),
    Family("interpreter", (ANY_INTERPRETER, either("socket", "fsockopen"), either(*SPAWNING)), (ANY_INTERPRETER, ANY_SHELL)),
    Family("socat", (program("socat"), either("exec:", "system:"), either("tcp", "udp", "ssl")), (program("socat"), ANY_SHELL)),
)


def reverse_shell(command: Column, actor: Column | None = None) -> Column:
    """The name of the first family that a command is of; null if it is of none.

    command and actor are in lower case. With an actor, it must be a program that runs commands of that family.
    """
    found = []
    for family in FAMILIES:
        holds = F.lit(True)
        for sign in family.signs:
            holds = holds & matches(command, sign)
        if actor is not None:
            holds = holds & F.coalesce(matches(tail(actor), "^(?:" + "|".join(family.actors) + ")$"), F.lit(False))
        found.append(F.when(holds, family.name))
    return F.coalesce(*found)


def is_external(ip: Column) -> Column:
    """Whether an address is one, and neither that of the own host nor unspecified; also for IPv4 in IPv6."""
    plain = F.regexp_replace(F.lower(F.trim(ip)), "^::ffff:(?=[0-9.]+$)", "")
    four = plain.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!$)|$)){4}$")
    six = plain.contains(":") & plain.rlike("^[0-9a-f:.]+$")
    none = plain.startswith("127.") | (plain == "0.0.0.0") | plain.rlike("^[0:]+1?$")
    return F.coalesce((four | six) & ~none, F.lit(False))

"""Detection rules on observations of hosts: processes, persistence, services and sockets.

Observations are rows with any of FIELDS; what lacks counts as null, and a predicate on nulls doesn't hold. All rules are
evaluated in one pass without a shuffle; facts.keyed_fold makes facts of what they find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shell as X
from .facts import Rule, candidates

FIELDS = {
    "host": "string", "process": "string", "parent": "string", "command": "string", "exe": "string", "pid": "string", "exe_deleted": "boolean", "mechanism": "string", "item": "string", "action": "string",
    "service": "string", "unquoted_risk": "boolean", "destination_ip": "string", "destination_port": "int", "kind": "string", "state": "string", "remote_ip": "string", "remote_port": "int",
}
#: What the rules look for.
DUMPERS = ("mimikatz", "procdump", "comsvcs.dll", "sekurlsa")
SURVEYS = ("whoami", "net user", "nltest")
OFFICE = ("winword", "excel", "powerpnt", "outlook", "w3wp")
WINDOWS_SHELLS = ("cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe")
ODD_FOLDERS = ("\\appdata\\local\\temp", "\\users\\public")
CONTROL_PORTS = (4444, 1337, 8888, 9001, 5555)
PACKAGED = ("/usr/", "/bin/", "/sbin/", "/lib", "/opt/")
MECHANISMS = {
    "cron": "T1053.003", "cron_periodic": "T1053.003", "systemd_timer": "T1053.006", "systemd_service": "T1543.002", "systemd_user_service": "T1543.002", "rc_local": "T1037.004", "xdg_autostart": "T1547.013",
}


def complete(observations: DataFrame) -> DataFrame:
    """observations with all of FIELDS."""
    return observations.withColumns({name: F.lit(None).cast(kind) for name, kind in FIELDS.items() if name not in observations.columns})


def rules() -> list[Rule]:
    command, process, parent, exe, action = (F.lower(c) for c in ("command", "process", "parent", "exe", "action"))
    host, mechanism = F.coalesce("host", F.lit("localhost")), F.col("mechanism")
    actor = F.when(F.coalesce(process, F.lit("")) == "", F.lower(X.tail(F.col("exe")))).otherwise(process)
    key = lambda *parts: F.concat_ws(":", host, *(F.lit(p) if p.islower() and p not in FIELDS else F.coalesce(p, F.lit("")) for p in parts))
    child = X.has(process, *WINDOWS_SHELLS)
    windows_powershell = X.has(F.coalesce(process, F.lit("")), "powershell", "pwsh")
    from_linux = F.coalesce(F.col("exe").startswith("/"), F.lit(False))
    socket, remote = F.concat_ws(":", "destination_ip", F.coalesce("destination_port", F.lit(0))), F.concat_ws(":", "remote_ip", F.coalesce("remote_port", F.lit(0)))
    reverse, piped = X.reverse_shell(command, actor).isNotNull(), X.is_shell(actor) & X.pipes_download(command)
    kept, deleted = mechanism.isin(*MECHANISMS), F.col("exe_deleted") & (F.col("exe") != "")
    memory, packaged = F.col("exe").startswith("/memfd:"), X.begins(F.col("exe"), *PACKAGED)
    return [
        Rule("WIN-001a", X.has(command, *DUMPERS), key("proc", "cred_dump"), "CredentialAccessAttempt", 0.95, "Critical", 95.0),
        Rule("WIN-001b", command.contains("schtasks") & command.contains("/create"), key("proc", "persist", "schtasks"), "ScheduledTaskPersistence", 0.85, "High", 85.0),
        Rule("WIN-001c", X.has(command, *SURVEYS), key("proc", "recon"), "DiscoveryReconnaissance", 0.75, "Medium", 60.0),
        Rule("WIN-001d", X.has(command, "-enc") & ~(from_linux & ~windows_powershell), key("proc", "obfuscated"), "ObfuscatedExecution", 0.85, "High", 80.0),
        Rule("WIN-001e", X.has(parent, *OFFICE) & child, key("proc", "office_shell", "process"), "OfficeSpawnedShell", 0.95, "Critical", 92.0),
        Rule("WIN-001f", X.has(exe, *ODD_FOLDERS) & exe.endswith(".exe"), key("proc", "susp_path", "process"), "SuspiciousProcessLocation", 0.80, "High", 75.0),
        Rule("WIN-002", X.has(action, *ODD_FOLDERS) | (action.contains("powershell") & action.contains("-w hidden")), key("persist", "suspicious"), "SuspiciousPersistenceMechanism", 0.90, "High", 85.0),
        Rule("WIN-004", F.col("unquoted_risk"), key("service", "unquoted", "service"), "UnquotedServicePath", 0.85, "Medium", 55.0),
        Rule("WIN-003a", F.col("destination_port").isin(*CONTROL_PORTS) & F.col("destination_ip").isNotNull(), socket, "SuspiciousC2Connection", 0.90, "Critical", 88.0, "socket"),
        Rule("WIN-003b", child & ~X.begins(F.col("destination_ip"), "127.", "0.0.") & (F.col("destination_ip") != ""), socket, "ShellExternalConnection", 0.95, "Critical", 94.0, "socket"),
        Rule("LIN-001a", reverse, key("proc", "revshell", "pid"), "ReverseShellCommandLine", 0.95, "Critical", 95.0, "line"),
        Rule("LIN-001d", piped, key("proc", "download_exec", "pid"), "DownloadPipedToShell", 0.85, "High", 80.0, "line"),
        Rule("LIN-001b", X.in_open_dir(F.col("exe")), key("proc", "ww_exec", "exe"), "ProcessFromWorldWritableDir", 0.80, "High", 75.0),
        Rule("LIN-001e", deleted & memory, key("proc", "memfd", "exe"), "FilelessMemfdExecution", 0.85, "High", 80.0, "deleted"),
        Rule("LIN-001c", deleted & packaged, key("proc", "deleted_exe", "exe"), "DeletedExecutableRunning", 0.80, "Medium", 45.0, "deleted"),
        Rule("LIN-001c", deleted, key("proc", "deleted_exe", "exe"), "DeletedExecutableRunning", 0.80, "High", 80.0, "deleted"),
        Rule("LIN-002a", kept & X.reverse_shell(action).isNotNull(), key("persist", "mechanism", "item"), "SuspiciousLinuxPersistence", 0.90, "Critical", 95.0, "kept"),
        Rule("LIN-002a", kept & (X.pipes_download(action) | X.runs_from_open_dir(F.col("action"))), key("persist", "mechanism", "item"), "SuspiciousLinuxPersistence", 0.90, "High", 85.0, "kept"),
        Rule("LIN-002b", mechanism == "ld_preload", key("persist", "ld_preload", "item"), "DynamicLinkerPreload", 0.85, "High", 80.0),
        Rule("LIN-003", (F.col("kind") == "network_socket") & X.is_shell(actor) & (F.upper("state") == "ESTABLISHED") & X.is_external(F.col("remote_ip")), remote, "ShellNetworkConnection", 0.95, "Critical", 94.0),
    ]


def detect(observations: DataFrame) -> DataFrame:
    """A row for each observation and rule that holds for it."""
    return candidates(complete(observations), rules())

"""Names, patterns and lookup tables that results depend on."""

UNRESOLVED = "MULTI_TECHNIQUE_UNRESOLVED"

_SYSMON = "microsoft-windows-sysmon/operational"
_TASKS = "microsoft-windows-taskscheduler/operational"
_SHELL = "microsoft-windows-powershell/operational"

# Channel (lower case), event id, event type, meaning.
EVENT_TYPES = [
    (_SYSMON, 1, "process", "process started"),
    (_SYSMON, 5, "process", "process ended"),
    (_SYSMON, 10, "process", "process opened another process"),
    (_SYSMON, 3, "network", "network connection opened"),
    (_SYSMON, 11, "file", "file written"),
    (_SYSMON, 23, "file", "file deleted"),
    (_SYSMON, 12, "registry", "registry key added or removed"),
    (_SYSMON, 13, "registry", "registry value written"),
    (_SYSMON, 14, "registry", "registry key or value renamed"),
    ("security", 4688, "process", "process started"),
    ("security", 4689, "process", "process ended"),
    ("security", 4656, "file", "object handle requested"),
    ("security", 4663, "file", "object accessed"),
    ("security", 4690, "file", "object handle duplicated"),
    ("security", 5156, "network", "filter allowed a connection"),
    ("security", 5158, "network", "filter allowed a local bind"),
    ("security", 4624, "authentication", "logon succeeded"),
    ("security", 4625, "authentication", "logon failed"),
    ("security", 4672, "authentication", "special privileges assigned at logon"),
    (_TASKS, 129, "scheduled_task", "task launched"),
    (_TASKS, 106, "scheduled_task", "task registered"),
    ("windows powershell", 800, "process", "shell pipeline executed"),
    (_SHELL, 4103, "process", "shell command logged"),
    (_SHELL, 4104, "process", "shell script block logged"),
]
OTHER_MEANING = "event type without a description; judge by its fields"

# Fields that tell who acted, and on what.
ACTOR_FIELDS = ["CommandLine", "ParentCommandLine", "ParentImage", "User", "SubjectUserName", "TargetUserName", "ScriptBlockText"]
OBJECT_FIELDS = ["DestinationIp", "DestinationHostname"]
EMPTY_VALUES = ["", "-", "-\\-"]

# Fields whose text the rules read, in order.
TEXT_FIELDS = ["CommandLine", "ParentCommandLine", "Image", "ParentImage", "TargetObject", "ScriptBlockText"]

# Names of system binaries.
BINARY_NAMES = [
    "powershell.exe", "cmd.exe", "wmic.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe", "mshta.exe", "schtasks.exe",
    "net.exe", "net1.exe", "wscript.exe", "cscript.exe", "bitsadmin.exe", "psexec.exe", "reg.exe",
]

# Patterns of suspicious commands, without regard to case.
COMMAND_PATTERNS = [
    r"-enc(odedcommand)?\b",
    r"-e\s+[a-z0-9+/=]{20,}",
    r"-nop\b",
    r"-windowstyle\s+hidden",
    r"-noni(nteractive)?\b",
    r"bypass",
    r"downloadstring|downloadfile|invoke-webrequest|iwr\b|net\.webclient",
    r"invoke-expression|iex\b",
    r"net\s+localgroup\s+administrators",
    r"net\s+(user|group)\s",
    r"whoami\s*/(all|priv|groups)",
    r"reg\s+(add|save)\s+[^\n]{0,200}\\run\b",
    r"schtasks\s*/create",
    r"\\currentversion\\run\b",
]

# Keys that features must not count.
SUPPRESSED_KEYS = [
    "ProviderGuid", "ThreadID", "RecordNumber", "ExecutionProcessID", "Opcode", "@timestamp", "EventTime", "UtcTime",
    "CreationUtcTime", "PreviousCreationUtcTime", "EventReceivedTime", "Hostname", "@version",
]

# Keys without a counterpart on the other side.
UNMAPPABLE_KEYS = ["Opcode", "ProviderGuid", "ThreadID", "RecordNumber", "ExecutionProcessID"]

# Keys that only a collector adds, and keys that depend on the agent's version.
COLLECTOR_KEYS = [
    "@version", "Category", "EventReceivedTime", "EventType", "EventTypeOrignal", "Message", "OpcodeValue", "SeverityValue",
    "Severity", "SourceModuleName", "SourceModuleType", "SourceName", "host", "port", "tags", "AccountName", "AccountType", "Domain",
]
VERSION_KEYS = ["Level", "ProcessId", "ParentUser"]

# Keys that both sides must have, by event id.
CORE_KEYS = {1: ["Channel", "EventID", "Hostname", "Image", "CommandLine", "ProcessGuid", "ParentImage", "User"]}

# Keys whose text is a time.
TIME_KEYS = ["@timestamp", "EventTime", "UtcTime", "CreationUtcTime", "PreviousCreationUtcTime"]

POLICIES = ["conservative", "high_precision", "abstention"]

"""Fixed values of the decoy-server log format and of the reports built on it.

Everything in this file has to keep its value for results to come out right;
operators take them as parameter defaults.
"""

from datetime import timedelta

# --- Fixed values: event codes and their display names ---------------------
EVENT_NAMES = {
    "cowrie.login.success": "Successful Login",
    "cowrie.login.failed": "Failed Login",
    "cowrie.session.connect": "Session Connected",
    "cowrie.session.closed": "Session Closed",
    "cowrie.command.input": "Command Executed",
    "cowrie.session.file_download": "File Downloaded",
    "cowrie.session.file_upload": "File Uploaded",
    "cowrie.client.version": "SSH Client Version",
    "cowrie.client.kex": "SSH Key Exchange",
    "cowrie.direct-tcpip.request": "TCP Tunnel Request",
    "cowrie.direct-tcpip.data": "TCP Tunnel Data",
}

LOGIN_SUCCESS = "cowrie.login.success"
LOGIN_FAILED = "cowrie.login.failed"
SESSION_CONNECT = "cowrie.session.connect"
SESSION_CLOSED = "cowrie.session.closed"
COMMAND_INPUT = "cowrie.command.input"
FILE_DOWNLOAD = "cowrie.session.file_download"
TUNNEL_DATA = "cowrie.direct-tcpip.data"

UNKNOWN = "unknown"

# --- Fixed values: detection rules -----------------------------------------
MALWARE_URL_PARTS = (".exe", ".sh", ".py")
ESCALATION_KEYWORDS = ("sudo", "su", "chmod +s", "passwd")
RECON_KEYWORDS = ("whoami", "uname", "ps", "netstat", "ifconfig", "ls /etc")
BRUTE_FORCE_THRESHOLD = 10
BRUTE_FORCE_WINDOW = timedelta(hours=1)

# --- Fixed values: report sizes --------------------------------------------
TOP_LIMIT = 20
RECENT_LIMIT = 100
CARD_LIMIT = 12
ATTACKER_CARD_LIMIT = 3
COMMAND_MAX_LENGTH = 100
COMMAND_CUT_LENGTH = 97
COMMAND_CUT_MARK = "..."

# --- Fixed values: time presets (hours; "all" has no bound) ----------------
PRESET_HOURS = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}
ALL_PRESET = "all"
DEFAULT_PRESET = "24h"

# --- Fixed values: log file layouts ----------------------------------------
LIVE_FILE = "live/cowrie.json"
ARCHIVE_PREFIX = "archive/cowrie.json."
LIVE_FILE_PATTERN = r"(^|/)live/cowrie\.json$"
ARCHIVE_FILE_PATTERN = r"(^|/)archive/cowrie\.json\.[^/]*$"
HISTORICAL_FILE_PATTERN = r"(^|/)historical/cowrie\.json[^/]*$"
DAILY_FILE_PATTERN = r"(^|/)cowrie-\d{4}-\d{2}-\d{2}\.json$"

# --- Fixed values: text rules ----------------------------------------------
# White space as the log's producers and viewers understand it: a larger set
# than the blanks that SQL trim() and Java's \s remove.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITESPACE_CLASS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
REQUEST_PATTERN = (
    rf"(?i)(?:GET|POST)[{WHITESPACE_CLASS}]+([^{WHITESPACE_CLASS}]+)[{WHITESPACE_CLASS}]+HTTP"
)
HOST_PATTERN = rf"(?i)Host:[{WHITESPACE_CLASS}]*([^\r\n\\]+)"

# --- Fixed values: line states ---------------------------------------------
OK = "ok"
BLANK = "blank"
MALFORMED = "malformed"
NO_TIMESTAMP = "no_timestamp"
BAD_TIMESTAMP = "bad_timestamp"
ADMITTED = (OK, BAD_TIMESTAMP)

"""Policy values that the registered queries and their checks share."""

BLOCKED = ("npm publish", "make (", r"script_1\b")
APPROVAL = ("chmod 777", r"git push .* \+", r"systemctl\s+restart")
RETENTION_CUTOFF = "2024-01-05 00:00:00"
RETENTION_DAYS = 30

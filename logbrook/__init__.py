"""logbrook: session-log redaction, reporting and bundle auditing as Spark DataFrame plans."""

__version__ = "0.1.0"

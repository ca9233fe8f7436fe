"""Rules that look only at a field's name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The rules below must give the same result as the published behaviour.
PORT_MARK = "port"
INTERNAL_PREFIX = "p_"
EVENT_TIME = "p_event_time"
TEMPORAL_FEATURES = ("hour", "day_of_week")
EXCLUDED_FEATURE = "is_business_hours"
HOUR_DUPLICATE = "hour_of_day"
TIME_FIELDS_TRAINING = ("p_event_time", "timestamp", "createdAt")
TIME_FIELDS_INGEST = ("timestamp", "createdAt", "p_event_time")
IDENTITY_FIELDS = ("id", "alertId", "timestamp")
ALERT_FIELDS = ("alertId", "severity", "title", "runbook")
AUDIT_FIELDS = ("actor", "action", "resource")
ALERT_LOG_TYPE = "alert_logs"
AUDIT_LOG_TYPE = "audit_logs"
SOURCE_FIELD = "eventsource"
SOURCE_TO_LOG_TYPE = {
    "iam.amazonaws.com": "AWS IAM",
    "config.amazonaws.com": "AWS Config",
    "vpc-flow-logs.amazonaws.com": "AWS VPC Flow",
}
FIELD_ALIASES = {
    "recipientaccountid": "recipientAccountId",
    "useragent": "userAgent",
    "useridentity.accountId": "userIdentity.accountId",
    "useridentity.type": "userIdentity.type",
    "useridentity.invokedBy": "userIdentity.invokedBy",
    "useridentity.sessionContext.sessionIssuer.accountId": "userIdentity.sessionContext.sessionIssuer.accountId",
    "useridentity.sessionContext.sessionIssuer.userName": "userIdentity.sessionContext.sessionIssuer.userName",
    "eventname": "eventName",
    "eventsource": "eventSource",
    "eventtype": "eventType",
    "eventversion": "eventVersion",
    "eventcategory": "eventCategory",
    "eventtime": "eventTime",
    "awsregion": "awsRegion",
    "sourceipaddress": "sourceIPAddress",
    "requestid": "requestId",
    "eventid": "eventId",
}


def c(name: str) -> Column:
    """The top-level column called ``name``; flat names hold dots and brackets, so they are always quoted."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_port_name(name: str) -> bool:
    """Port-like names are categories whatever their type; one mark covers srcport, dest_port, server_port, ..."""
    return PORT_MARK in name.lower()


def is_port(feature: Column) -> Column:
    """The same rule on a column of feature names."""
    return F.lower(feature).contains(PORT_MARK)


def is_internal_name(name: str) -> bool:
    """Fields added by the log platform; the event time is the only one kept for modelling."""
    return name.startswith(INTERNAL_PREFIX) and name != EVENT_TIME

"""The tables that tests read, and dates from text."""

import os
from datetime import datetime

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)

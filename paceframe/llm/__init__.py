"""Operators for preparing language-model training data; nothing else in the library imports this folder."""

from paceframe.runtime import send_by_value

send_by_value()

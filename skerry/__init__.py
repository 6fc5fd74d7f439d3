"""skerry: field-station analytics as Spark DataFrame functions.

Every public function takes DataFrames and returns a lazy DataFrame, so Catalyst sees one plan
from scan to result. See the README for the map of modules.
"""

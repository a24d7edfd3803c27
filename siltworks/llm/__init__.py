"""Training-corpus operators. Nothing outside this subpackage (and the guarded part of
``__spark_entry__``) imports it; it imports nothing from the rest of the library."""

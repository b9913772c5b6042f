"""Column expressions (``Column -> Column``): null hygiene, weather formulas,
calendar features, holiday rules and report formatting. All are built-in
Spark SQL expressions, so they stay inside whole-stage code generation."""

from flowcast.functions.columns import clean_double, is_finite, guarded_clip, round_doubles  # noqa: F401

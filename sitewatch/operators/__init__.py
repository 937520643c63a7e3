"""Loading steps, analytic views, edit checks and dashboard frames."""

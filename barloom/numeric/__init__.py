"""Small dense numerics that run on the driver or inside one task."""

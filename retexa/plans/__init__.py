"""Plans that span several operators."""

"""Quality, relation, profile, split, model and scoring operators."""

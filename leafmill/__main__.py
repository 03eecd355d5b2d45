from leafmill.plans.batch import main

raise SystemExit(main())
